"""Operators for training-data pipelines over tables of texts and web pages; nothing else in the library imports this subpackage."""
