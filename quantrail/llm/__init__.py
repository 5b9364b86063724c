"""Training-data operators: text cleaning, deduplication, scoring, packing and search on Spark DataFrames."""
