"""Operators for training-data pipelines, each by its own method. Nothing outside this subpackage imports it."""
