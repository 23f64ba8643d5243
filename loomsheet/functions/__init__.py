"""Column expressions: path resolution, predicates, date buckets."""
