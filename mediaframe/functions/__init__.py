"""Column functions: bytes, text, scalar helpers."""
