"""Column functions (no shuffles, no Python per row)."""
