"""Ship-track analytics around submarine-cable corridors, on Spark DataFrames."""
