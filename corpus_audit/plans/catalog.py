"""All registered queries and their SQL twins."""

from corpus_audit.plans import code_queries, repo_queries  # noqa: F401  (registers the queries)
from corpus_audit.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
