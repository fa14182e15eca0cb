"""Fixed tables and column expressions."""
