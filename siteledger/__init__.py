"""Analytics over source-code decision metrics, on Spark DataFrames."""
