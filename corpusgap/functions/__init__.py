"""Column functions: text, statistics, fixed values."""
