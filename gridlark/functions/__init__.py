"""Column-level functions. All of them are JVM expressions, none is a Python UDF."""
