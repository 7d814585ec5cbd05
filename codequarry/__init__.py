"""codequarry: code-quality analytics over tables, on Spark DataFrames."""
