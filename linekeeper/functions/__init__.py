"""Column functions: text, time, arrays."""
