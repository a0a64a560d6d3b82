"""Interaction analytics and recommendation on Spark DataFrames."""
