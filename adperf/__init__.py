"""Ad-performance analytics and model-health monitoring on Spark DataFrames."""
