"""Column functions; every one builds a native Spark expression unless its docstring says otherwise."""
