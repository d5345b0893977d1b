"""Column functions: no I/O, no Python workers."""
