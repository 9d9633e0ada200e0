"""Retrieval, ranking and training-data operators: functions from DataFrames to a DataFrame."""
