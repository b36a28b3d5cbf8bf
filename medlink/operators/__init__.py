"""Table-level operators: each takes and returns ``DataFrame`` values."""
