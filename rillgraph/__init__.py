"""Affinity-graph segmentation on Spark DataFrames."""
