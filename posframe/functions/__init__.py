"""Column expressions: codecs, features, schedules."""
