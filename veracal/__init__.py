"""Confidence and calibration analytics on Spark DataFrames."""
