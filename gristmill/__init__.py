"""Gristmill: catalogue enrichment and corpus preparation on Spark DataFrames."""
