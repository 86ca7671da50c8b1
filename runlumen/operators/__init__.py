"""Data operators: functions from DataFrames to DataFrames."""
