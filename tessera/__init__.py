"""Scene-evaluation analytics and corpus operators on Spark DataFrames."""
