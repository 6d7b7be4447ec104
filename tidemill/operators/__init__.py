"""Operators: functions from DataFrames to DataFrames. None collects rows; ties are broken by total orders; no clock is read."""
