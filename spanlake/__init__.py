"""Analytics over LLM call spans and HTTP access logs, on Spark DataFrames and streams."""
