"""Domain-neutral DataFrame operators."""
