"""Training-data operators: mixing, token files, scoring, search, deduplication, packing.

Every operator takes and returns DataFrames. Nothing outside this folder imports it.
"""
