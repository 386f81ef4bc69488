"""Column-level helpers: text, numbers, term counts, sequence and distribution UDFs."""
