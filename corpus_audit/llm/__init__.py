"""Operators for preparing training data: tokens, filters, near-duplicates, archives and fingerprints."""
