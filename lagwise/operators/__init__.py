"""Operators: functions from DataFrames to a DataFrame, with the key columns as arguments."""
