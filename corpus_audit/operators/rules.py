"""Rules: what makes a file an issue.

A family is a set of named features (pattern counts or flags, one expression each) and rules over them.
Rule conditions are SQL expressions on the feature names, so a rule is data and users can add their own
with :func:`register_rule`.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from typing import Callable

from pyspark.sql import Column

Feature = object  # Has, Count or Derived


@dataclass(frozen=True)
class Rule:
    rule_id: str
    type: str
    when: str  # boolean SQL over feature names
    description: str  # string SQL over feature names
    n: str = "1"  # how many occurrences the issue stands for
    severity: str = "NULL"  # string SQL
    remediation: str = "NULL"  # string SQL
    polarity: str = "issue"


@dataclass(frozen=True)
class Family:
    name: str
    features: dict[str, Feature]
    rules: tuple[Rule, ...]
    applies_to: Callable[[Column], Column]  # path predicate


def register_rule(family: Family, rule: Rule, features: dict[str, Feature] | None = None) -> Family:
    """A copy of ``family`` with one more rule (and the features it needs)."""
    merged = {**family.features, **(features or {})}
    if any(r.rule_id == rule.rule_id for r in family.rules):
        raise ValueError(f"rule id {rule.rule_id!r} is taken in family {family.name!r}")
    return replace(family, features=merged, rules=family.rules + (rule,))


def text(value: str) -> str:
    """A SQL string literal that Spark and other engines read alike."""
    return "'" + value.replace("'", "''") + "'"


def counted(feature: str, tail: str) -> str:
    return f"concat(CAST({feature} AS STRING), {text(tail)})"
