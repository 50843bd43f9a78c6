"""Operators on observation ledgers: functions from DataFrames to DataFrames."""
