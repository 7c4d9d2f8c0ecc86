"""Database-schema hygiene as Spark DataFrames."""
