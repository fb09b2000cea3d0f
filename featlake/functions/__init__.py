"""Column functions: times, texts, arrays."""
