"""Column-level functions: each takes and returns ``Column`` values."""
