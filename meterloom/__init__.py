"""Meter analytics on Spark DataFrames.

Every operator takes and returns DataFrames; a reading is ``id, date, usage``.
"""
