"""Analytics over execution traces and other interval-shaped event data on Spark DataFrames."""
