"""Column expressions and small tail-probability helpers."""
