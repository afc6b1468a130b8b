"""Marketplace advertising performance analytics on Spark DataFrames."""
