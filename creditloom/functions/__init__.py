"""Column expressions: row-wise, shuffle-free, usable on batch and streaming frames."""
