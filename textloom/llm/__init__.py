"""Operators for large training-data pipelines. Nothing else in textloom imports this subpackage."""
