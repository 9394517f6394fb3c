"""screenlake: analytics over libraries of screen recordings, on Spark DataFrames."""
