"""Operators: functions from Column to Column, or from DataFrame to DataFrame for use with transform()."""
