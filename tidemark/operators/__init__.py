"""Operators: functions from DataFrames to DataFrames, one series per partition key."""
