"""Operators of a training-data pipeline, each by its own method. Nothing else in the library imports this package."""
