"""Operators of a training-data pipeline: each is a DataFrame-in, DataFrame-out function."""
