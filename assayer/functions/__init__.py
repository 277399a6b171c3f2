"""Column expressions: pure Catalyst, no Python in the data path."""
