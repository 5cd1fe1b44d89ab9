"""Operators of a training-data pipeline, each by the method its module names."""
