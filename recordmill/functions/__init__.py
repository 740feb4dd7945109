"""Column builders for standardising and comparing values."""
