"""Operators for training-data pipelines: DataFrames in, DataFrames out.

Nothing else in the library imports this subpackage.
"""
