"""Operators for training-data pipelines over tables of documents and pages.

Nothing else in the library imports this subpackage; it may import general helpers.
"""
