"""Training-data operators: filtering, near-duplicates, decontamination, token counts and packing.

Nothing else in the library imports this package.  Every operator takes and
returns DataFrames, keeps its own general parameters, and states in its
docstring what it does with nulls, empty texts, ties and empty tables.
"""
