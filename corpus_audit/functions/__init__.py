"""Column-level building blocks: patterns, path predicates, per-file metrics, value checks."""
