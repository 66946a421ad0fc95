"""Regular-expression features over a text column.

Patterns are written once, in the plain form shared by most engines (ASCII ``\\b``, ``.`` stopping at
line ends).  This module turns a pattern into a Spark expression that

* keeps the plain meaning on the JVM (Unicode-aware ``\\b`` and the wider ``.`` are rewritten),
* runs in time linear in the text even on very long lines, and
* skips the regex engine altogether when a literal the pattern needs is absent.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NEWLINES = r"\n\r\x{2028}\x{2029}"
LINE_CHAR = f"[^{NEWLINES}]"
LINE_START = f"(?<!{LINE_CHAR})"

_META = set(".^$*+?()[]{}|\\")


def _tokens(pattern: str):
    """Yield (text, depth, in_class) for each regex token of ``pattern``."""
    depth, in_class, i = 0, False, 0
    while i < len(pattern):
        token = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        if token == "[" and not in_class:
            in_class = True
            yield token, depth, True
        elif token == "]" and in_class:
            yield token, depth, True
            in_class = False
        else:
            if not in_class and token == ")":
                depth -= 1
            yield token, depth, in_class
            if not in_class and token == "(":
                depth += 1
        i += len(token)


def _split_flags(pattern: str) -> tuple[str, str]:
    if pattern.startswith("(?i)"):
        return "(?i)", pattern[4:]
    return "", pattern


def branches(pattern: str) -> list[str]:
    """Split at top-level ``|``."""
    out = [""]
    for token, depth, in_class in _tokens(pattern):
        if token == "|" and depth == 0 and not in_class:
            out.append("")
        else:
            out[-1] += token
    return out


def java_regex(pattern: str) -> str:
    """Plain pattern to the Java form: ASCII word boundary, ``.`` as 'not a line end'.

    A leading boundary is checked after the literal it precedes, so the scan can search for the literal.
    """
    out, behind = "", ""
    if pattern.startswith(r"\b") and (word := literal_prefix(pattern[2:])):
        escaped = re.escape(word)
        out, behind = f"{escaped}(?<!\\w{escaped})", word[-1]
        pattern = pattern[2 + len(word) :]
    for token, _, in_class in _tokens(pattern):
        if token == "." and not in_class:
            out += LINE_CHAR
        elif token == r"\b" and not in_class:
            # After a word or a repetition of word characters it ends a word, otherwise it starts one.
            out += r"(?!\w)" if behind.isalnum() or behind in ("_", "}", "+", "*") else r"(?<!\w)"
        else:
            out += token
        behind = token[-1]
    return out


def literal_of(pattern: str) -> str | None:
    """The text ``pattern`` stands for when it holds no operator, else None."""
    out = ""
    for token, _, _ in _tokens(pattern):
        if len(token) == 2:
            if token[1].isalnum():
                return None
            out += token[1]
        elif token in _META:
            return None
        else:
            out += token
    return out


def literal_prefix(pattern: str) -> str:
    """Leading text every match must start with (may be empty)."""
    out = ""
    for token, _, _ in _tokens(pattern):
        if token in ("*", "?", "{"):
            return out[:-1]
        if len(token) == 2 and not token[1].isalnum():
            out += token[1]
        elif len(token) == 1 and token not in _META:
            out += token
        else:
            return out
    return out


def _leading_group(branch: str) -> str | None:
    """Inner pattern of a plain group that opens ``branch`` and is not repeated."""
    if not branch.startswith("(") or branch.startswith("(?"):
        return None
    inner = ""
    for i, (token, depth, in_class) in enumerate(_tokens(branch)):
        if i and token == ")" and depth == 0 and not in_class:
            return None if branch[len(inner) + 2 : len(inner) + 3] in tuple("*?{") else inner
        if i:
            inner += token
    return None


def required_literals(pattern: str) -> list[str] | None:
    """Literals of which a matching text must contain at least one; None when there is no such list."""
    flags, body = _split_flags(pattern)
    if flags:
        return None
    found: list[str] = []
    for branch in branches(body):
        branch = branch.removeprefix(r"\b")
        group = _leading_group(branch)
        needed = required_literals(group) if group is not None else [literal_prefix(branch)]
        if not needed or not all(needed):
            return None
        found += needed
    return list(dict.fromkeys(found))


def _ordered_parts(branch: str) -> tuple[str, list[str]] | None:
    """``A.*B`` or ``A[\\s\\S]*B`` at top level: the gap kind and the parts."""
    for gap in (r"[\s\S]*?", r"[\s\S]*", ".*"):
        parts, current, rest, depth, in_class = [], "", branch, 0, False
        while rest:
            if rest.startswith(gap) and depth == 0 and not in_class:
                parts.append(current)
                current, rest = "", rest[len(gap) :]
                continue
            token = rest[:2] if rest[0] == "\\" else rest[0]
            if token == "[":
                in_class = True
            elif token == "]":
                in_class = False
            elif not in_class:
                depth += (token == "(") - (token == ")")
            current += token
            rest = rest[len(token) :]
        parts.append(current)
        if len(parts) > 1:
            return ("line" if gap == ".*" else "file"), parts
    return None


def linear_regex(pattern: str) -> str:
    """Presence-only Java regex equal to ``pattern`` but linear in the text.

    ``A.*B.*C`` tries every A, every B behind it, and rescans the line each time.  For a presence test
    the first A, then the first B behind it, are enough, so each line is walked once.  Valid when the
    parts do not cross line ends, which holds for every pattern this is used on.
    """
    flags, body = _split_flags(pattern)
    out = []
    for branch in branches(body):
        split = _ordered_parts(branch)
        if split is None or any(r"\s" in p and split[0] == "line" for p in split[1]):
            out.append(java_regex(branch))
            continue
        kind, parts = split
        anchor, char = (LINE_START, LINE_CHAR) if kind == "line" else (r"\A", r"[\s\S]")
        steps = "".join(f"(?>{char}*?{java_regex(p)})" for p in parts[:-1])
        out.append(f"{anchor}{steps}{char}*?{java_regex(parts[-1])}")
    return flags + "|".join(out)


def _any(tests: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _holds(text: Column, literals: list[str]) -> Column:
    return _any([F.contains(text, F.lit(x)) for x in literals])


def _worth_trying(text: Column, pattern: str, needs: tuple[str, ...]) -> Column | None:
    """Cheap test that fails on texts the pattern cannot match; None when there is none."""
    if needs:
        return reduce(lambda a, b: a & b, [F.contains(text, F.lit(x)) for x in needs])
    flags, body = _split_flags(pattern)
    tests = []
    for branch in branches(body):
        split = _ordered_parts(branch)
        if split is None:
            literals = required_literals(branch) if not flags else None
            if not literals:
                return None
            tests.append(_holds(text, literals))
            continue
        # Every part of A.*B has to occur somewhere.
        found = []
        for part in split[1]:
            if flags:
                found.append(F.rlike(text, F.lit(flags + java_regex(part))))
            elif literals := required_literals(part):
                found.append(_holds(text, literals))
        if not found:
            return None
        tests.append(reduce(lambda a, b: a & b, found))
    return _any(tests)


def matches(text: Column, pattern: str, linear: str | None = None, needs: tuple[str, ...] = ()) -> Column:
    """True when ``pattern`` occurs in ``text``.  Pure literals become ``contains``."""
    flags, body = _split_flags(pattern)
    if linear is None and not flags:
        literals = [literal_of(b) for b in branches(body)]
        if all(literals):
            return _holds(text, literals)
    test = F.rlike(text, F.lit(linear_regex(pattern) if linear is None else java_regex(linear)))
    cheap = _worth_trying(text, pattern, needs)
    return test if cheap is None else cheap & test


def matches_any(text: Column, patterns: list[str]) -> Column:
    """True when one of ``patterns`` occurs.

    Literal tests come first because they are cheapest; plain case-insensitive patterns become one regex.
    """
    literal = [p for p in patterns if literal_of(p)]
    folded = [p for p in patterns if p.startswith("(?i)") and _ordered_parts(p) is None]
    others = [p for p in patterns if p not in literal and p not in folded]
    if len(folded) > 1:
        folded = ["(?i)" + "|".join(_split_flags(p)[1] for p in folded)]
    return _any([matches(text, p) for p in literal + others + folded])


def count_matches(
    text: Column, pattern: str, linear: str | None = None, needs: tuple[str, ...] = ()
) -> Column:
    """Number of non-overlapping matches, as BIGINT."""
    literal = literal_of(pattern)
    if literal:
        removed = F.octet_length(F.replace(text, F.lit(literal), F.lit("")))
        return F.floor((F.octet_length(text) - removed) / len(literal.encode())).cast("bigint")
    n = F.regexp_count(text, F.lit(java_regex(linear or pattern))).cast("bigint")
    cheap = _worth_trying(text, pattern, needs)
    # A NULL text must stay NULL, so the guard only answers for present texts.
    return n if cheap is None else F.when(~cheap, F.lit(0).cast("bigint")).otherwise(n)


@dataclass(frozen=True)
class Has:
    """Presence of a pattern.

    ``linear`` is an equal pattern whose time is linear in the text; ``needs`` are literals every match
    contains, for patterns whose text does not show them at the start.
    """

    pattern: str
    linear: str | None = None
    needs: tuple[str, ...] = ()

    def column(self, text: Column) -> Column:
        return matches(text, self.pattern, self.linear, self.needs)


@dataclass(frozen=True)
class Count:
    """Number of matches of a pattern; ``linear`` and ``needs`` as in :class:`Has`.

    ``build`` replaces the regex by an equal expression where no linear regex exists.
    """

    pattern: str
    linear: str | None = None
    needs: tuple[str, ...] = ()
    build: Callable[[Column], Column] | None = None

    def column(self, text: Column) -> Column:
        if self.build is not None:
            return self.build(text)
        return count_matches(text, self.pattern, self.linear, self.needs)


@dataclass(frozen=True)
class Derived:
    """A feature that is not one pattern: ``build(text) -> Column`` plus its SQL twin for checks."""

    build: Callable[[Column], Column]
    sql: str

    def column(self, text: Column) -> Column:
        return self.build(text)


def _pieces(text: Column, mark: str, count: Callable[[Column], Column]) -> Column:
    """``count`` of the array of pieces of ``text`` around ``mark``; 0 for texts without it."""
    n = F.aggregate(
        F.array(F.split(text, re.escape(mark))), F.lit(0).cast("bigint"), lambda acc, s: acc + count(s).cast("bigint")
    )
    return F.when(~F.contains(text, F.lit(mark)), F.lit(0).cast("bigint")).otherwise(n)


def wide_parentheses(least: int) -> Callable[[Column], Column]:
    """Count of ``\\([^)]{least,}\\)``.

    Up to each ``)`` only the first ``(`` can match, as it leaves the longest inside, so pieces between
    closing parentheses are measured and none is scanned twice.
    """

    def count(s: Column) -> Column:
        closed = F.slice(s, F.lit(1), F.size(s) - 1)
        return F.size(
            F.filter(closed, lambda x: (F.instr(x, "(") > 0) & (F.length(x) - F.instr(x, "(") >= least))
        )

    return lambda text: _pieces(text, ")", count)


def walked(walk: str, *needs: str) -> Callable[[Column], Column]:
    """Count of the matches of ``walk`` in which its only group took part; 0 for texts without one of ``needs``.

    A head whose match fails would be scanned again from every head inside it.  So ``walk`` lets a failing head
    consume what all heads inside share with it (up to the parenthesis that closes them), and marks real matches
    by the group.
    """

    def count(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(walk), 1)
        n = F.array_size(F.filter(found, lambda x: x != "")).cast("bigint")
        return F.when(~reduce(lambda a, b: a & b, [F.contains(text, F.lit(x)) for x in needs]), F.lit(0).cast("bigint")).otherwise(n)

    return count


def until(word: str, stop: str, last: bool = False) -> str:
    """Java regex of all characters but ``stop`` up to and with the first (or last) ``word``, without backtracking."""
    head = word[:2] if word[0] == "\\" else word[0]
    rest = word[len(head) :]
    skip = f"(?:[^{stop}{head}]++|{head}(?!{rest}))*+"
    return f"(?:{skip}{word})++" if last else f"{skip}{word}"


def call_heads(text: Column, named: str, arrow: str, call: str) -> Column:
    """Count of ``named``, of ``arrow`` up to ``) =>`` and of ``call`` up to ``) {``, where the latter two end in an
    opening parenthesis.

    What follows a ``)`` decides for all heads before it.  So the text is cut behind each ``)``, and a piece is
    searched once: a head that its end fulfils takes the rest of the piece, others are no heads.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"[^)]*+\)(?:\s*+(?:\{|=>))?+|[^)]++"), 0)

    def count(x: Column) -> Column:
        def of(*heads: str) -> Column:
            return F.regexp_count(x, F.lit("|".join([named, *(rf"{h}[\s\S]*+" for h in heads)]))).cast("bigint")

        closed = F.contains(x, F.lit(")"))
        opens = F.when(closed & F.endswith(x, F.lit("{")), of(call)).when(closed & F.endswith(x, F.lit("=>")), of(arrow))
        return opens.otherwise(of())

    return F.aggregate(pieces, F.lit(0).cast("bigint"), lambda acc, x: acc + count(x))


def braces_assigned(text: Column) -> Column:
    """Count of ``\\{[^}]*\\}\\s*=``: pieces that hold a ``{`` and are followed by one that starts with ``=``."""
    return _pieces(
        text,
        "}",
        lambda s: F.size(
            F.filter(
                s,
                lambda x, i: F.contains(x, F.lit("{"))
                & F.coalesce(F.rlike(F.get(s, i + 1), F.lit(r"\A\s*+=")), F.lit(False)),
            )
        ),
    )
