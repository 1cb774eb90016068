"""Analytics of admixed-population genetics on Spark DataFrames."""
