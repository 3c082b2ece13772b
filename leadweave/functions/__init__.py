"""Column-to-column building blocks; every one is a plain Catalyst expression."""
