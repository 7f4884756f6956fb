"""Operators for preparing training text: scoring, deduplication, decontamination, mixing.

Nothing outside this package imports it. Operators take and return DataFrames; each module states
how it treats nulls, empty and very long texts, ties, repeated rows and empty tables.
"""
