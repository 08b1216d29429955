"""A PySpark-native media analytics engine: files are rows, byte parsing runs in Arrow kernels, the rest is Spark SQL."""
