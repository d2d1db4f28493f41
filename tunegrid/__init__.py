"""Set-at-a-time rating analytics and recommendation operators on Spark DataFrames."""
