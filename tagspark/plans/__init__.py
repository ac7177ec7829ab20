"""Library views over the given tables, and the named queries on them."""
