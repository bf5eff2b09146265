"""The catalog of named queries."""
