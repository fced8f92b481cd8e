"""Column expressions (no shuffles, no joins)."""
