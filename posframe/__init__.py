"""posframe: sparse labelled positions and corpus operators on Spark DataFrames."""
