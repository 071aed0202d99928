"""A temporal-graph analytics engine built on Spark DataFrames."""
