"""Column expressions that operators share; all built in, none a Python function per row."""
