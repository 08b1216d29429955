"""Byte and pixel kernels in plain Python and NumPy; nothing here imports Spark."""
