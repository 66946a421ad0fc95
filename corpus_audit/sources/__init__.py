"""Readers and writers: files, ignore rules, manifests, config entries, reports."""
