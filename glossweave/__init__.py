"""Text extraction, counting and dictionary application on Spark DataFrames."""
