"""Column functions: rules over bytes, tags, pixels and page boxes as built-in Spark expressions."""
