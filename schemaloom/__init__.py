"""Schema-aware analytics over many tables, written for Spark DataFrames."""
