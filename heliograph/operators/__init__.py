"""Operators: functions from DataFrames to DataFrames, without state."""
