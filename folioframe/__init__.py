"""Analytics over scanned documents and text corpora on Spark DataFrames."""
