"""Operators that need match positions, which SQL functions do not return: function bodies and symbols.

Each is an Arrow-batched function from one text to a small array; classification, counting and every join
stay in DataFrame expressions.  A file's text is never shuffled.
"""

from __future__ import annotations

import re
import sys
from bisect import bisect_left
from functools import cached_property, reduce

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpus_audit.functions import paths as P

# --- fixed values: function and symbol patterns, word lists and window sizes ------------------------
BODY_FUNCTIONS = (
    r"(function\s+\w+\s*\([^)]*\)|const\s+\w+\s*=\s*\([^)]*\)\s*=>|async\s+function|\w+\s*\([^)]*\)\s*\{)"
)
SIZED_FUNCTIONS = (
    r"(function\s+\w+|const\s+\w+\s*=\s*(?:async\s*)?\([^)]*\)\s*=>|async\s+function|\w+\s*\([^)]*\)\s*\{)"
)
SIDE_EFFECTS = [
    r"console\.",
    r"document\.",
    r"window\.",
    r"localStorage",
    r"sessionStorage",
    r"fetch\(",
    r"axios\.",
    r"process\.env",
    r"fs\.",
    r"require\(",
    r"import\s+.*from",
]
LOCAL_STATE = r"(let|var)\s+\w+"
LONG_FUNCTION, LARGE_FUNCTION = 20, 30
HEAD_CHARS = 50
CLASSES = r"(?:export\s+)?class\s+(\w+)"
FUNCTIONS = r"(?:export\s+)?(?:async\s+)?function\s+(\w+)"
METHODS = r"(?m)^\s*(?:async\s+)?(\w+)\s*\([^)]*\)\s*\{"
ARROWS = r"(?:export\s+)?const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>"
DOC_BLOCKS = r"/\*\*[\s\S]*?\*/"
LIFECYCLE_METHODS = ["constructor", "componentDidMount", "componentWillUnmount", "render"]
TEST_METHODS = ["test", "it", "describe", "beforeEach", "afterEach", "beforeAll", "afterAll"]
KEYWORDS = [
    "if",
    "for",
    "while",
    "switch",
    "case",
    "do",
    "try",
    "catch",
    "finally",
    "else",
    "return",
    "throw",
]
COMMON_METHODS = [
    "length",
    "push",
    "pop",
    "shift",
    "slice",
    "map",
    "filter",
    "reduce",
    "forEach",
    "find",
    "includes",
]
# --- end of fixed values -----------------------------------------------------------------------------

_NL = "\n\r\u2028\u2029"


def _compile(pattern: str) -> re.Pattern:
    """Plain pattern as a Python one: ASCII classes, ``.`` and ``^`` as in the other engines."""
    pattern = pattern.replace(".*", f"[^{_NL}]*").replace("(?m)^", f"(?<![^{_NL}])")
    return re.compile(pattern, re.ASCII)


# Function-like matches in order of preference: how one starts, and what has to follow the next ``)`` (None: the
# start is the whole match).  A call-like head can only start where a run of word characters starts, or right after
# a keyword match.
_RUN_START = r"(?:(?<!\w)|(?<=function))\w++\s*+\("
_ANY, _ARROW_FOLLOWS, _BODY_FOLLOWS = r"", r"\s*+=>", r"\s*+\{"
BODY_HEADS = [
    (r"function\s+\w++\s*+\(", _ANY),
    (r"const\s+\w++\s*+=\s*+\(", _ARROW_FOLLOWS),
    (r"async\s+function", None),
    (_RUN_START, _BODY_FOLLOWS),
]
SIZED_HEADS = [
    (r"function\s+\w++", None),
    (r"const\s+\w++\s*+=\s*+(?:async\s*)?\(", _ARROW_FOLLOWS),
    (r"async\s+function", None),
    (_RUN_START, _BODY_FOLLOWS),
]
ARROW_HEADS = [(r"(?:export\s+)?const\s+(\w++)\s*+=\s*+(?:async\s+)?\(", _ARROW_FOLLOWS)]


class Parentheses:
    """What follows the first ``)`` behind a place; each ``)`` is looked at once, however many heads precede it."""

    def __init__(self, text: str):
        self.text = text
        self.closing = [m.start() for m in re.finditer(r"\)", text)]
        self.known: dict[tuple[int, str], int] = {}

    def end(self, at: int, follows: str) -> int:
        """Where ``[^)]*\\)`` and ``follows`` end when they start at ``at``; -1 if they don't match."""
        k = bisect_left(self.closing, at)
        if k == len(self.closing):
            return -1
        key = k, follows
        if key not in self.known:
            m = _compile(follows).match(self.text, self.closing[k] + 1)
            self.known[key] = m.end() if m else -1
        return self.known[key]


class HeadFinder:
    """Function-like matches of a list of heads, found as one pattern of these alternatives would find them, without
    going through the text of unclosed parentheses again."""

    def __init__(self, heads: list[tuple[str, str | None]]):
        self.heads = [(_compile(start), follows) for start, follows in heads]
        self.any = _compile("|".join(start for start, _ in heads))

    def find(self, text: str, parentheses: Parentheses):
        """Start, end and the match of the start, for each."""
        at = 0
        while at <= len(text) and (m := self.any.search(text, at)):
            start = m.start()
            at = start + 1
            for head, follows in self.heads:
                if (found := head.match(text, start)) is None:
                    continue
                end = found.end() if follows is None else parentheses.end(found.end(), follows)
                if end >= 0:
                    yield start, end, found
                    at = max(end, at)
                    break


_BODY_HEADS, _SIZED_HEADS, _ARROW_HEADS = HeadFinder(BODY_HEADS), HeadFinder(SIZED_HEADS), HeadFinder(ARROW_HEADS)
# An import is found apart: what follows it may be a whole line.
_IMPORT = re.compile(r"import\s++", re.ASCII)
_EFFECT = _compile("|".join(p for p in SIDE_EFFECTS if not p.startswith("import")))
_LOCAL = _compile(f"(?=({LOCAL_STATE.removesuffix('+')}))")  # the shortest match; one may start inside another
_RETURN, _THIS = re.compile("return"), re.compile(r"this\.")
_BRACES_AND_QUOTES = re.compile(r"[\"'`{}]")


class BodyFinder:
    """Ends of brace-delimited bodies in one text, strings skipped, in one backward pass.

    ``end(start)`` is the position after the ``}`` that first brings the brace count from ``start`` back to
    zero; where there is none, the end of the text, or ``unclosed`` characters further.
    """

    def __init__(self, text: str, unclosed: int | None = None):
        self.text, self.unclosed = text, unclosed
        self.at = [m.start() for m in _BRACES_AND_QUOTES.finditer(text)]
        n = len(self.at)
        self.next = [n] * (n + 1)  # following token outside strings
        self.pair = [-1] * (n + 1)  # token that brings the count back to its value before this one
        self.close = [-1] * (n + 1)  # first '}' that brings the count to zero when counting starts here
        closing: dict[str, int] = {}
        for i in range(n - 1, -1, -1):
            ch = text[self.at[i]]
            if ch in "{}":
                self.next[i] = i + 1
                self._match(i, ch)
            else:
                end = closing.get(ch)
                self.next[i] = n if end is None else end + 1
                self.close[i] = self.close[self.next[i]]
                if self.at[i] == 0 or text[self.at[i] - 1] != "\\":
                    closing[ch] = i

    def _outside(self, i: int) -> int:
        """First brace at or after token ``i`` on the path that skips strings."""
        while i < len(self.at) and self.text[self.at[i]] not in "{}":
            i = self.next[i]
        return i

    def _match(self, i: int, ch: str) -> None:
        n = len(self.at)
        j = self._outside(i + 1)
        while j < n and self.text[self.at[j]] == ch:
            if self.pair[j] < 0:
                j = n
                break
            j = self._outside(self.pair[j] + 1)
        if j >= n:
            return
        self.pair[i] = j
        self.close[i] = j if ch == "{" else self.close[self._outside(j + 1)]

    def end(self, start: int) -> int:
        first = bisect_left(self.at, start)
        closed = self.close[first] if first < len(self.at) else -1
        if closed >= 0:
            return self.at[closed] + 1
        return len(self.text) if self.unclosed is None else min(start + self.unclosed, len(self.text))


class Occurrences:
    """Places of a mark, with a look-up of whether one lies within a span.

    ``found``: start and end of the shortest match at each place where the mark starts, in order.  Of all matches from
    a place on, the least end is kept, so a look-up is one bisection, however many spans hold the same matches.
    """

    def __init__(self, found: list[tuple[int, int]]):
        self.starts = [a for a, _ in found]
        self.ends = [z for _, z in found]
        for k in range(len(found) - 2, -1, -1):
            self.ends[k] = min(self.ends[k], self.ends[k + 1])

    def within(self, start: int, end: int) -> bool:
        k = bisect_left(self.starts, start)
        return k < len(self.starts) and self.ends[k] <= end


def _spans_of(pattern: re.Pattern, text: str) -> list[tuple[int, int]]:
    return [m.span(m.re.groups and 1) for m in pattern.finditer(text)]


def _imports(text: str) -> list[tuple[int, int]]:
    """Each ``import`` with the next ``from`` of the line that follows its blanks."""
    if "import" not in text:
        return []
    sources, breaks, out = [m.start() for m in re.finditer("from", text)], [m.start() for m in re.finditer(f"[{_NL}]", text)], []
    for m in _IMPORT.finditer(text):
        k, j = bisect_left(sources, m.end()), bisect_left(breaks, m.end())
        if k < len(sources) and (j == len(breaks) or sources[k] < breaks[j]):
            out.append((m.start(), sources[k] + len("from")))
    return out


def body_facts(text: str, unclosed: int | None = None) -> list[dict]:
    """What the body of every function-like match holds."""
    if text is None or not (heads := list(_BODY_HEADS.find(text, Parentheses(text)))):
        return []
    finder, out = BodyFinder(text, unclosed), []
    effects = Occurrences(sorted(_spans_of(_EFFECT, text) + _imports(text)))
    returns, this, local = (Occurrences(_spans_of(p, text)) for p in (_RETURN, _THIS, _LOCAL))
    for start, _, _ in heads:
        end = finder.end(start)
        out.append(
            {
                "has_effect": effects.within(start, end),
                "returns": returns.within(start, end),
                "uses_this": this.within(start, end),
                "has_local_state": local.within(start, end),
            }
        )
    return out


def function_spans(text: str, unclosed: int | None = None) -> list[dict]:
    """Head, first line and line count of every function-like match."""
    if text is None or not (heads := list(_SIZED_HEADS.find(text, Parentheses(text)))):
        return []
    finder, out, newlines = BodyFinder(text, unclosed), [], [m.start() for m in re.finditer("\n", text)]
    for start, end, _ in heads:
        before = bisect_left(newlines, start)
        out.append(
            {
                "head": text[start : min(end, start + HEAD_CHARS)],
                "line": before + 1,
                "lines": bisect_left(newlines, finder.end(start)) - before + 1,
            }
        )
    return out


# CLASSES and FUNCTIONS without the optional words before them: a literal first is what ``re`` finds fast.
_CLASS, _FUNCTION = _compile(r"class\s+(\w+)"), _compile(r"function\s+(\w+)")
_BLANKS = " \t\n\r\x0b\x0c"
_LINE_START = _compile(r"(?m)^\s*+")
_METHOD_NAME = _compile(r"(?:async\s+)?(\w+)\s*+\(")
_DOC = re.compile(DOC_BLOCKS)
_SKIPPED = set(LIFECYCLE_METHODS + TEST_METHODS + KEYWORDS + COMMON_METHODS)


class _Places:
    """Sorted positions of the marks that decide whether an index lies in a string or comment.

    Each list is built when first asked for; most texts hold no symbol and need none.
    """

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def newlines(self) -> list[int]:
        return [m.start() for m in re.finditer("\n", self.text)]

    @cached_property
    def quotes(self) -> list[list[int]]:
        return [[m.start() for m in re.finditer(q, self.text)] for q in "'\"`"]

    @cached_property
    def slashes(self) -> list[int]:
        return [m.start() for m in re.finditer(r"(?=//)", self.text)]

    # Overlapping finds ("/*/" holds both an opening and a closing mark).
    @cached_property
    def opened(self) -> list[int]:
        return [m.start() for m in re.finditer(r"(?=/\*)", self.text)]

    @cached_property
    def closed(self) -> list[int]:
        return [m.start() for m in re.finditer(r"(?=\*/)", self.text)]

    def line(self, index: int) -> int:
        return bisect_left(self.newlines, index) + 1

    def hidden(self, index: int) -> bool:
        if any(bisect_left(q, index) % 2 for q in self.quotes):
            return True
        k = bisect_left(self.newlines, index)
        line_start = self.newlines[k - 1] if k else 0
        j = bisect_left(self.slashes, line_start)
        if j < len(self.slashes) and self.slashes[j] + 2 <= index:
            return True

        def last(marks: list[int]) -> int:
            j = bisect_left(marks, index - 1)
            return marks[j - 1] if j else -1

        return last(self.opened) > last(self.closed)


def _methods(text: str, parentheses: Parentheses):
    """Start and name of every match of ``METHODS``.  Starts of blank lines before a name share what follows them."""
    at = 0
    while at <= len(text) and (m := _LINE_START.search(text, at)):
        at = max(m.end(), m.start() + 1)
        name = _METHOD_NAME.match(text, m.end())
        if name and (end := parentheses.end(name.end(), _BODY_FOLLOWS)) >= 0:
            yield m.start(), name.group(1)
            at = max(end, at)


def _declared(core: re.Pattern, words: tuple[str, ...], text: str):
    """Start and name of every match of ``core`` with the optional ``words`` before it, the nearest first."""
    done = 0
    for m in core.finditer(text):
        start = m.start()
        for word in words:
            before = text[done:start]
            bare = before.rstrip(_BLANKS)
            if len(bare) < len(before) and bare.endswith(word):
                start = done + len(bare) - len(word)
        yield start, m.group(1)
        done = m.end()


def _named(text: str):
    """Start, name and kind of classes, functions and methods, hidden ones included."""
    parentheses = Parentheses(text)
    yield from ((start, name, "class") for start, name in _declared(_CLASS, ("export",), text))
    yield from ((start, name, "function") for start, name in _declared(_FUNCTION, ("async", "export"), text))
    if "const" in text and "=>" in text:
        yield from ((start, m.group(1), "function") for start, _, m in _ARROW_HEADS.find(text, parentheses))
    if "{" in text:
        yield from ((start, name, "method") for start, name in _methods(text, parentheses))


def _skipped_method(name: str, text: str, at: int) -> bool:
    def before(n: int) -> str:
        return text[max(0, at - n) : at]

    if name in _SKIPPED or len(name) <= 1:
        return True
    if name.startswith(("get", "set")) and ("get " in before(50) or "set " in before(50)):
        return True
    after = text[at : at + 50]
    if f"{name}:" in before(100) or ": function" in after or ": async" in after:
        return True
    around = before(200) + after
    return any(control in around for control in ("if (", "for (", "while ("))


def _in_class(text: str, at: int) -> bool:
    before, after = text[max(0, at - 200) : at], text[at : at + 100]
    return (
        ("class " in before or "extends " in before)
        and (") {" in after)
        and not any(word in before for word in ("if ", "for ", "while ", "switch "))
        and " = " not in before
        and " = " not in after
    )


def symbols_of(text: str) -> dict:
    """Classes, functions and class methods with their lines, and the first lines of doc blocks.

    ``gap`` is how many lines away the nearest doc block starts (None without one).
    """
    if text is None:
        return {"symbols": [], "docblocks": []}
    places, found = _Places(text), []
    for start, name, kind in _named(text):
        if places.hidden(start):
            continue
        if kind == "method" and (_skipped_method(name, text, start) or not _in_class(text, start)):
            continue
        found.append({"name": name, "line": places.line(start), "kind": kind})
    # No block starts behind the last closing mark, so the search for unclosed ones stops there.
    blocks = [places.line(m.start()) for m in _DOC.finditer(text, 0, text.rfind("*/") + 2)] if "*/" in text else []
    for symbol in found:
        k = bisect_left(blocks, symbol["line"])
        near = blocks[max(0, k - 1) : k + 1]
        symbol["gap"] = min((abs(b - symbol["line"]) for b in near), default=None)
    return {"symbols": found, "docblocks": blocks}


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_FLAG, _INT, _TEXT = T.BooleanType(), T.IntegerType(), T.StringType()
_FACTS = T.ArrayType(_struct(has_effect=_FLAG, returns=_FLAG, uses_this=_FLAG, has_local_state=_FLAG))
_SPANS = T.ArrayType(_struct(head=_TEXT, line=_INT, lines=_INT))
_SYMBOLS = _struct(
    symbols=T.ArrayType(_struct(name=_TEXT, line=_INT, kind=_TEXT, gap=_INT)), docblocks=T.ArrayType(_INT)
)


# Executors receive these functions with the plan and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _per_text(fn, kind: T.DataType, unclosed: int | None):
    @F.pandas_udf(kind)
    def each(content: pd.Series) -> pd.Series:
        return content.map(lambda text: fn(text, unclosed), na_action=None)

    return each


@F.pandas_udf(_SYMBOLS)
def _symbols(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([symbols_of(t) for t in content], columns=["symbols", "docblocks"])


def _candidate(content: str, *marks: str) -> Column:
    """The text when it holds one of ``marks``, else NULL: other texts are not sent to Python."""
    return F.when(reduce(lambda a, b: a | b, [F.contains(content, F.lit(m)) for m in marks]), F.col(content))


_HEAD_MARKS = ["{", "function", "=>"]


def function_purity(files: DataFrame, unclosed: int | None = None) -> DataFrame:
    """Functions with side effects, pure ones and the rest, per repository.

    A body that is never closed is judged up to the end of its text, or ``unclosed`` characters of it."""
    facts = files.where(P.is_style_source(F.col("path"))).select(
        "repo", F.explode(_per_text(body_facts, _FACTS, unclosed)(_candidate("content", *_HEAD_MARKS))).alias("f")
    )
    effect = F.col("f.has_effect")
    pure = ~effect & F.col("f.returns") & ~F.col("f.uses_this") & ~F.col("f.has_local_state")
    counts = facts.groupBy("repo").agg(
        F.count_if(pure).alias("pure"),
        F.count_if(effect).alias("side_effects"),
        F.count_if(~effect & ~pure).alias("impure"),
    )
    return counts


def side_effect_ratio(purity: DataFrame) -> DataFrame:
    """Share of functions with side effects and whether it is high against the pure ones."""
    return purity.select(
        "repo",
        (F.col("side_effects") > F.col("pure") * 0.3).alias("high_side_effects"),
        F.round(
            F.try_divide(F.col("side_effects").cast("double"), F.col("pure") + F.col("side_effects")) * 100, 1
        ).alias("side_effect_percentage"),
    )


def function_sizes(files: DataFrame, longer_than: int = LONG_FUNCTION, unclosed: int | None = None) -> DataFrame:
    """Functions spanning more than ``longer_than`` lines, the very long ones marked.

    A body that is never closed reaches to the end of its text, or ``unclosed`` characters far."""
    return (
        files.where(P.is_style_source(F.col("path")))
        .select("repo", "path", F.explode(_per_text(function_spans, _SPANS, unclosed)(_candidate("content", *_HEAD_MARKS))).alias("f"))
        .select("repo", "path", "f.head", "f.line", "f.lines")
        .where(F.col("lines") > longer_than)
        .withColumn("is_large", F.col("lines") > LARGE_FUNCTION)
    )


def file_symbols(files: DataFrame) -> DataFrame:
    """One row per code file with its symbol and doc block arrays."""
    text = _candidate("content", *_HEAD_MARKS, "class", "/**")
    return (
        files.where(P.is_code(F.col("path")))
        .select("repo", "path", _symbols(text).alias("s"))
        .select("repo", "path", "s.symbols", "s.docblocks")
    )
