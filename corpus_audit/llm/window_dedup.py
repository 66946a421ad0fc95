"""Removal of word passages that repeat across documents, by Rabin-Karp hashes of every window.

A word has two independent hashes, the halves of its 128-bit XXH3.  A window's hash is a difference of prefix sums of a
polynomial in its words' hashes modulo 2^64, so each window costs a few vector operations.  Windows are counted in
Spark by 96 bits of two such hashes, one of each half.

Only windows that can repeat are shuffled.  The anchor of a window is the smallest hash of its 26 inner grams
of 25 words.  Equal windows have equal anchors, so a window whose anchor occurs in a single document occurs in
no other.  Anchors are about a thirteenth as many as windows, and are counted first.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import stored, text_batches, worker_cache

WINDOW = 50
BLOCK = 1 << 20  # windows hashed at a time in very long texts

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_U = np.uint64
_BASES = _U(0x9E3779B97F4A7C15), _U(0xD1B54A32D192ED03)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))



def _power_table(base: np.uint64, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^0 .. base^n and the same of its inverse, modulo 2^64."""
    powers = worker_cache("window_dedup")
    have = powers.get(int(base))
    if have is None or len(have[0]) <= n:
        size = max(n + 1, 1 << 15)
        have = powers[int(base)] = tuple(
            np.concatenate(([_U(1)], np.cumprod(np.full(size, b, np.uint64)))) for b in (base, _U(pow(int(base), -1, 1 << 64)))
        )
    return have


def _sums(values: np.ndarray, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _power_table(base, len(values))
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(values)]))), inverse


def word_bounds(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words ``[^\\x20\\x09-\\x0D]+`` of a UTF-8 text start and end, in bytes."""
    space = np.concatenate(([True], _SPACE[np.frombuffer(data, np.uint8)], [True]))
    edges = np.flatnonzero(space[1:] != space[:-1])
    return edges[0::2], edges[1::2]


def word_hashes(data: bytes) -> np.ndarray:
    """Two rows of hashes of the words of a UTF-8 text: no two words share both by chance, nor by a pattern of letters."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, data.split())), "<u8").reshape(-1, 2).T


def gram_hashes(hashes: np.ndarray, size: int, base: np.uint64 = _BASES[0]) -> np.ndarray:
    """The Rabin-Karp hash of every run of ``size`` words."""
    out = np.empty(max(0, len(hashes) - size + 1), np.uint64)
    for k in range(0, len(out), BLOCK):
        part = hashes[k : k + BLOCK + size - 1]
        sums, inverse = _sums(part, base)
        out[k : k + BLOCK] = _mixed((sums[size:] - sums[:-size]) * inverse[: len(part) - size + 1])
    return out


def _smallest(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every run of ``width`` values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[:-step], values[step:])
        have += step
    return values


def window_anchors(hashes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """The anchor of every window: the smallest hash of its grams of half its length."""
    gram = max(1, window // 2)
    return _smallest(gram_hashes(hashes, gram), window - gram + 1) if len(hashes) >= window else np.empty(0, np.uint64)


def merged(starts: np.ndarray, window: int) -> list[tuple[int, int]]:
    """Maximal word intervals (end not included) covered by windows at these starts."""
    starts = np.unique(starts)
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > window)
    return list(zip(starts[np.concatenate(([0], cut + 1))].tolist(), (starts[np.concatenate((cut, [-1]))] + window).tolist()))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _mark(text: str) -> int:
    return crc32(_bytes(text)) >> 1


def _hashed(text: str | None) -> np.ndarray:
    return word_hashes(_bytes(text))


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, anchor``: the different anchors of each row."""

    def each(batches):
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.iloc[start : start + 500]
                found = [np.unique(window_anchors(_hashed(t)[0], window)).view(np.int64) for t in part["text"]]
                yield part[["doc_id"]].loc[part.index.repeat([len(x) for x in found])].assign(anchor=np.concatenate(found))

    return docs.mapInPandas(each, "doc_id long, anchor long")


def _windows(docs: DataFrame, window: int) -> DataFrame:
    """``doc_id, pos, h1, h2``: the windows of each row whose anchor is among its ``anchors``.

    ``h2`` has 32 bits.  ``pos`` is the word at which the window starts, with a mark of the text above its 32 bits:
    rows that repeat an id with another text don't get each other's positions.
    """

    def each(batches):
        import pandas as pd

        for b in batches:
            for doc_id, text, anchors in zip(b["doc_id"], b["text"], b["anchors"]):
                words = _hashed(text)
                at = np.flatnonzero(np.isin(window_anchors(words[0], window).view(np.int64), np.asarray(anchors)))
                h1, h2 = (gram_hashes(half, window, base)[at] for half, base in zip(words, _BASES))
                for k in range(0, len(at), BLOCK):
                    cut = slice(k, k + BLOCK)
                    pos = at[cut].astype(np.int64) | (_mark(text) << 32)
                    yield pd.DataFrame({"doc_id": doc_id, "pos": pos, "h1": h1[cut].view(np.int64), "h2": (h2[cut] >> _U(32)).astype(np.uint32).view(np.int32)})

    return docs.mapInPandas(each, "doc_id long, pos long, h1 long, h2 int")


def _first_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, first_id``: documents whose whole text is that of a document with a smaller id."""
    known = stored(docs.select("doc_id", F.sha2("text", 256).alias("d")), "known")
    first = known.groupBy("d").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")).where("first_id < last_id")
    first = stored(first, "first-copies")  # plain sides: a large group of copies is split
    return known.join(first, "d").where("doc_id > first_id").select("doc_id", "first_id")


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, starts, is_copy``: where windows start that also start in a document with a smaller ``doc_id``.

    Only documents with such a window have a row.  ``docs``: ``doc_id long, text``.  Documents that are whole
    copies of a smaller one are marked ``is_copy`` (all their windows repeat); their windows are not formed,
    as those of the smallest copy stand for them.
    """
    docs = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    copies = stored(_first_copies(docs).distinct(), "copies")
    # An id may come with several texts: only ids whose texts are all copies are left out.
    texts = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    copies = copies.join(texts, "doc_id", "left_anti")
    anchors = stored(_anchors(docs, window), "anchors")
    shared = anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("anchor")
    shared = stored(shared, "shared")  # so that the join below has plain sides, whose hot keys Spark splits
    # One document holds at most as many anchors as windows, so its list is no larger than its text.
    chosen = anchors.join(shared, "anchor").join(copies, "doc_id", "left_anti").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    rows = stored(_windows(docs.join(chosen, "doc_id"), window), "windows")
    first = rows.groupBy("h1", "h2").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").select("h1", "h2", "a")
    first = stored(first, "first")
    found = rows.join(first, ["h1", "h2"]).where("doc_id > a").groupBy("doc_id").agg(F.collect_set("pos").alias("starts"))
    return found.withColumn("is_copy", F.lit(False)).unionByName(
        copies.select("doc_id", F.array().cast("array<long>").alias("starts"), F.lit(True).alias("is_copy")).distinct()
    )


def mark_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with ``n_words``, ``removed`` (array of word intervals ``start, end``), ``n_removed`` and
    ``kept_text``, the text without the words of those intervals.

    Every word is removed that a window of ``window`` words covers whose word sequence also starts in a
    document with a smaller ``doc_id``; windows are judged on the input.  ``kept_text`` is the text itself when
    nothing is removed, else it lacks each interval from its first word up to the next kept word.

    Null, empty and short texts have no windows and stay as they are (null stays null, with 0 words).  A row
    without ``doc_id`` neither loses words nor makes others lose them.  Rows that repeat an id count as one
    document: none loses words because of another.
    An empty table gives an empty result.  Other columns pass through; columns named like the results are
    replaced.
    """
    text_batches(docs.sparkSession)
    results = ["n_words", "removed", "n_removed", "kept_text"]
    base = docs.drop(*results)
    ids = base.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    repeats = stored(repeated_windows(ids, window), "repeats").select(F.col("doc_id").alias("__id"), "starts", "is_copy")
    joined = base.join(repeats, F.col("doc_id").cast("long") == F.col("__id"), "left")
    row = F.struct("text", "starts", F.coalesce("is_copy", F.lit(False)).alias("is_copy"))
    return joined.withColumn("__cut", _cut(window)(row)).select(
        *[base[c] for c in base.columns], *[F.col("__cut")[c].alias(c) for c in results]
    )


def _cut(window: int):
    @F.pandas_udf("n_words long, removed array<struct<start:int,end:int>>, n_removed long, kept_text string")
    def cut(rows):
        import pandas as pd

        out = []
        for text, starts, is_copy in zip(rows["text"], rows["starts"], rows["is_copy"]):
            if text is None:
                out.append((0, [], 0, None))
                continue
            data = _bytes(text)
            begins, ends = word_bounds(data)
            n = len(begins)
            if is_copy:
                spans = [(0, n)] if n >= window else []
            elif starts is None or not len(starts):
                spans = []
            else:
                at = np.asarray(starts)
                spans = merged(at[at >> 32 == _mark(text)] & 0xFFFFFFFF, window)
            kept, at = [], 0
            for a, z in spans:
                kept.append(data[at : begins[a]])
                at = begins[z] if z < n else len(data)
            kept.append(data[at:])
            out.append((n, [{"start": a, "end": z} for a, z in spans], sum(z - a for a, z in spans), b"".join(kept).decode("utf-8", "surrogatepass") if spans else text))
        return pd.DataFrame(out, columns=["n_words", "removed", "n_removed", "kept_text"])

    return cut

