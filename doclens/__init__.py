"""doclens: analysis of scanned-document collections on Spark DataFrames."""
