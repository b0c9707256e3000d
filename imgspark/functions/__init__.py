"""Column expressions on manifest rows, pixels and progress."""
