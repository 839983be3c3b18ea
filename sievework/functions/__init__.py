"""Scalar functions: Column expressions that Catalyst compiles, no Python per row."""
