"""Analytics over adaptively refined lattices, written for Spark DataFrames."""
