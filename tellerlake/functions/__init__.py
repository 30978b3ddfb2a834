"""Column expressions: text, numbers, buckets, segments and rule scores."""
