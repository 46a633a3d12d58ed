"""Column functions: no Python on the executors."""
