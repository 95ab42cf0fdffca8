"""Tidewater: context-budget analytics on Spark DataFrames."""
