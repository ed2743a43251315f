"""kvlake: an ordered key/value analytics engine expressed as Spark DataFrames."""
