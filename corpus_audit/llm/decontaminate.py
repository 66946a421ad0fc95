"""Benchmark decontamination with a generalised suffix automaton of the test items' words.

The automaton holds every run of words of a block of items.  A document's words are streamed through it; at each
word it knows the longest run ending there that occurs in an item.  Where that run has at least ``window`` words,
the last ``window`` of them are one item's window and are hit; where it ends with a whole item that is shorter than
a window, that item's words are hit.  Words in no item lead back to the start, so most texts cost one look-up a word.

Items are read in blocks of bounded size; a block's automaton is sent to the executors and all documents stream
through it.  Several blocks mean several passes, whose hits are united per document.
"""

from __future__ import annotations

import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import LOWERED, WORD, stored, text_batches, worker_cache, words_of

WINDOW = 10
MAX_COVERAGE = 0.8
BLOCK_BYTES = 4 << 20  # of item texts in one automaton, which takes about 19 bytes for each in every worker


class ItemAutomaton:
    """Suffix automaton of several word sequences, with the items whose windows each state stands for.

    Words are numbers, and states are places in arrays.  Most states have one move, held in two arrays; further moves are in
    a dict of the few states that branch, and those of the root, one for each word, in an array.
    """

    def __init__(self, items: list[tuple[str, list[str]]], window: int = WINDOW):
        self.window = window
        self.number: dict[str, int] = {}  # of each word
        self.root = array("i")  # by word
        self.word, self.to = array("i", [-1]), array("i", [0])  # a state's first move
        self.more: dict[int, dict[int, int]] = {}
        self.link, self.length = array("i", [-1]), array("i", [0])
        ends = array("i"), array("i"), array("i")  # state, item, words up to there
        self.items = [name for name, _ in items]
        for number, (_, words) in enumerate(items):
            state = 0
            for k, word in enumerate(words):
                known = self.number.setdefault(word, len(self.number))
                if known == len(self.root):
                    self.root.append(-1)
                state = self._extend(state, known)
                if k + 1 >= window or k + 1 == len(words):
                    for out, value in zip(ends, (state, number, k + 1)):
                        out.append(value)
        self._name_states(ends, {n: len(words) for n, (_, words) in enumerate(items)})

    def _move(self, state: int, word: int) -> int:
        """-1 where there is none."""
        if state == 0:
            return self.root[word]
        if self.word[state] == word:
            return self.to[state]
        return self.more[state].get(word, -1) if state in self.more else -1

    def _set(self, state: int, word: int, target: int) -> None:
        if state == 0:
            self.root[word] = target
        elif self.word[state] in (-1, word):
            self.word[state], self.to[state] = word, target
        else:
            self.more.setdefault(state, {})[word] = target

    def _state(self, length: int, link: int, like: int = -1) -> int:
        """A new state, with the moves of ``like``."""
        new = len(self.link)
        self.link.append(link)
        self.length.append(length)
        self.word.append(self.word[like] if like > 0 else -1)
        self.to.append(self.to[like] if like > 0 else 0)
        if like in self.more:
            self.more[new] = dict(self.more[like])
        return new

    def _split(self, state: int, word: int) -> int:
        """The state of exactly the longest run of ``state`` and ``word``; split off where it shares one."""
        target = self._move(state, word)
        if self.length[target] == self.length[state] + 1:
            return target
        part = self._state(self.length[state] + 1, self.link[target], target)
        self.link[target] = part
        while state >= 0 and self._move(state, word) == target:
            self._set(state, word, part)
            state = self.link[state]
        return part

    def _extend(self, last: int, word: int) -> int:
        if self._move(last, word) >= 0:
            return self._split(last, word)
        new, state = self._state(self.length[last] + 1, 0), last
        while state >= 0 and self._move(state, word) < 0:
            self._set(state, word, new)
            state = self.link[state]
        if state >= 0:
            self.link[new] = self._split(state, word)
        return new

    def _above(self, state: int, words: int) -> int:
        """The state of the last ``words`` words of the runs of ``state``."""
        while self.length[self.link[state]] >= words:
            state = self.link[state]
        return state

    def _name_states(self, ends, sizes) -> None:
        """``only``: the item of a window's state, and ``several`` for those of more; ``short``: state of a whole short item ->
        (words, items); ``near_short``: the nearest state at or above each that ``short`` has."""
        self.only = array("i", [-1]) * len(self.link)
        self.several: dict[int, set[int]] = {}
        short: dict[int, dict[int, set[int]]] = {}
        for state, item, k in zip(*ends):
            if k >= self.window:
                at = self._above(state, self.window)
                if self.only[at] < 0:
                    self.only[at] = item
                elif self.only[at] != item:
                    self.several.setdefault(at, {self.only[at]}).add(item)
            elif k == sizes[item]:
                short.setdefault(self._above(state, k), {}).setdefault(k, set()).add(item)
        self.short = {s: [(k, tuple(sorted(i))) for k, i in sorted(v.items())] for s, v in short.items()}
        self.near_short = array("i", [-1]) * len(self.link)
        for state in np.argsort(np.frombuffer(self.length, np.int32), kind="stable")[1:].tolist() if self.short else ():
            self.near_short[state] = state if state in self.short else self.near_short[self.link[state]]

    def windows_of(self, state: int) -> set[int] | tuple[int, ...]:
        """The items of the window that a state stands for."""
        return self.several.get(state) or ((self.only[state],) if self.only[state] >= 0 else ())

    def match(self, words: list[str]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit word intervals (end not included, merged, ascending) and the items with occurring windows."""
        number, root, first, to, more = self.number, self.root, self.word, self.to, self.more
        link, length, window, near_short = self.link, self.length, self.window, self.near_short
        seen: set[int] = set()
        hits: list[tuple[int, int]] = []
        items: set[int] = set()
        state = have = 0
        for at, word in enumerate(words):
            known = number.get(word, -1)
            if known < 0:
                state = have = 0
                continue
            while state:
                if first[state] == known:
                    state, have = to[state], have + 1
                    break
                if state in more and (target := more[state].get(known, -1)) >= 0:
                    state, have = target, have + 1
                    break
                state = link[state]
                have = length[state]
            else:
                state, have = root[known], 1
            if have >= window:
                hits.append((at + 1 - window, at + 1))
                if state not in seen:
                    seen.add(state)
                    items.update(self.windows_of(self._above(state, window)))
            short = near_short[state]
            while short > 0:
                for k, names in self.short[short]:
                    if k <= have:
                        hits.append((at + 1 - k, at + 1))
                        items.update(names)
                short = near_short[link[short]]
        return merged(hits), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(z, out[-1][1]))
        else:
            out.append((a, z))
    return out


def item_blocks(items: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list[tuple[str, str]]]:
    """``(item_id, text)`` in blocks of about so many bytes, never more than one block and one item at a time."""
    block, size = [], 0
    for item_id, text in items.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string"), "text").toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item_id, text))
        size += len(text)
    if block:
        yield block


def _automaton(name: str, sent, window: int) -> ItemAutomaton:
    """The automaton of a broadcast block, built once in each worker; ``name`` is that of this block alone."""
    known = worker_cache("decontaminate")
    if name not in known:
        known.clear()
        known[name] = ItemAutomaton([(i, words_of(t)) for i, t in sent.value], window)
    return known[name]


def _block_hits(docs: DataFrame, block: list[tuple[str, str]], window: int, united: bool) -> DataFrame:
    """``docs`` with ``__hits``: ``n_words``, ``spans``, ``items`` and the text without the spans.

    ``united``: ``docs`` has ``spans`` and ``items`` of other blocks, which are added.  One function does it all, so a
    task keeps one Python process; it counts as not deterministic, so that later filters don't call it again."""
    sent, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def row(automaton, text, spans, items):
        words = words_of(text)
        found, numbers = automaton.match(words)
        names = {automaton.items[i] for i in numbers}.union(items)
        if len(spans):
            found = merged(_pairs(spans) + found)
        return len(words), [{"start": a, "end": z} for a, z in found], sorted(names), without_words(text, found)

    kind = "n_words long, spans array<struct<start:int,end:int>>, items array<string>, clean_text string"
    names = ["n_words", "spans", "items", "clean_text"]
    if united:

        @F.pandas_udf(kind)
        def more_hits(texts: pd.Series, spans: pd.Series, items: pd.Series) -> pd.DataFrame:
            automaton = _automaton(name, sent, window)
            return pd.DataFrame([row(automaton, *r) for r in zip(texts, spans, items)], columns=names)

        return docs.withColumn("__hits", more_hits.asNondeterministic()("text", "spans", "items"))

    @F.pandas_udf(kind)
    def hits(texts: pd.Series) -> pd.DataFrame:
        automaton = _automaton(name, sent, window)
        return pd.DataFrame([row(automaton, text, (), ()) for text in texts], columns=names)

    return docs.withColumn("__hits", hits.asNondeterministic()("text"))


def without_words(text: str | None, spans: list[tuple[int, int]]) -> str | None:
    """``text`` without these word intervals, each cut up to the next word."""
    if text is None or not spans:
        return text
    starts = [m.start() for m in WORD.finditer(text.translate(LOWERED))]  # which has the same offsets as the text
    kept, last = [], 0
    for a, z in spans:
        kept.append(text[last : starts[a]])
        last = starts[z] if z < len(starts) else len(text)
    return "".join([*kept, text[last:]])


def _pairs(spans) -> list[tuple[int, int]]:
    return [(s["start"], s["end"]) for s in spans]


def mark_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """``docs`` with ``n_words``, ``spans`` (hit word intervals), ``n_hit``, ``items`` (ids as strings, sorted),
    ``coverage`` (hit share of the words), ``over_limit`` (coverage above ``max_coverage``) and ``clean_text``
    (the text without the hit spans, each cut up to the next word).

    ``docs``: ``text`` and any other columns, which pass through; those named like the results are replaced.
    ``items``: ``item_id, text``.  Null and empty texts have no words and no hits (a null text stays null);
    items without words, text or id match nothing; items that repeat are named once.  Without items, or in an
    empty table, nothing is hit.
    """
    text_batches(docs.sparkSession)
    results = ["n_words", "spans", "n_hit", "items", "coverage", "over_limit", "clean_text"]
    rows = docs.drop(*results)
    columns = rows.columns
    blocks = item_blocks(items.select("item_id", "text"), block_bytes)
    marked = _block_hits(rows, next(blocks, []), window, united=False).select(*columns, "__hits.*")
    for block in blocks:  # the hits so far are stored, so that each pass holds one block
        marked = stored(marked.drop("n_words", "clean_text"), "decontaminate")
        marked = _block_hits(marked, block, window, united=True).select(*columns, "__hits.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    marked = marked.withColumn("n_hit", n_hit).withColumn("coverage", F.when(F.col("n_words") > 0, F.col("n_hit") / F.col("n_words")).otherwise(0.0))
    return marked.withColumn("over_limit", F.col("coverage") > max_coverage).select(
        *columns, "n_words", "spans", "n_hit", "items", "coverage", "over_limit", "clean_text"
    )
