"""Operators: functions from DataFrames to DataFrames, lazy but where they say so."""
