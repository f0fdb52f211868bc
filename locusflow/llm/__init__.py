"""Operators of a training-data pipeline: dedup, search, classification, packing.

Nothing else in the library imports this subpackage.
"""
