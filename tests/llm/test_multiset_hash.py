"""Multiset hashes: order, insertion and deletion, likeness, and edited texts against a direct computation."""

import hashlib
import random
import re

import pytest
from corpus_audit.llm import multiset_hash as M
from corpus_audit.llm import queries
from pyspark.sql import functions as F


def vectors(spark, texts):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return {r["k"]: r["v"] for r in df.select("k", M.fingerprint_vector(F.col("text")).alias("v")).collect()}


def test_order_insertion_and_deletion(spark):
    v = vectors(spark, ["a b. c d\ne f\ng", "g\n\ne f\na b. c d", "e f\ng", "a b. c d", None, "", "g\ng", "g", "a b. c d\ne f\nG"])
    assert v[0] == v[1] and v[4] == v[5] and set(v[4]) == {0} and len(v[0]) == 69
    assert len({tuple(x) for x in v.values()}) == 7
    pairs = spark.createDataFrame([(v[2], v[3], v[0]), (v[7], v[7], v[6]), (v[4], v[0], v[0])], "a array<long>, b array<long>, both array<long>")
    a, b, both = F.col("a"), F.col("b"), F.col("both")
    ok = pairs.select(M.combine(a, b) == both, M.combine(both, b, -1) == a, M.combine(both, a, -1) == b).collect()
    assert all(all(r) for r in ok)


def test_many_paragraphs_pass_the_modulus(spark):
    v = vectors(spark, ["x\n" * 40_000, "x\n" * 39_999, "x", "y\n" * 20_000 + "x"])
    pairs = spark.createDataFrame([(v[0], v[1], v[2])], "a array<long>, b array<long>, c array<long>")
    assert pairs.where(M.combine(F.col("b"), F.col("c")) == F.col("a")).count() == 1


def test_likeness(spark):
    base = [f"sentence number {k} of the text." for k in range(60)]
    texts = ["\n".join(base), "\n".join(base[:40] + [f"other {k}" for k in range(20)]), "\n".join(f"different {k}" for k in range(60)), "", " ".join(base)]
    v = vectors(spark, texts)
    pairs = spark.createDataFrame([(v[0], v[k]) for k in range(5)], "a array<long>, b array<long>")
    near = [r[0] for r in pairs.select(M.likeness(F.col("a"), F.col("b"))).collect()]
    assert near[0] == 1.0 and near[1] == pytest.approx(2 / 3, abs=0.2) and near[2] < 0.3 and near[3] == 0.0 and near[4] == pytest.approx(1.0)


def check(df):
    made = M.compare_with_edits(df)
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().toString())
    rows = made.withColumn("f", M.as_string(F.col("vector"))).withColumn("n", M.as_string(F.col("next_vector"))).collect()
    texts = [(r["doc_id"], r["text"] or "") for r in df.collect()]

    def place(r):
        digest = hashlib.md5((("-" if r[0] is None else "+") + r[1]).encode()).hexdigest()
        return (r[0] is not None, r[0] or 0, digest)

    order = sorted(set(texts), key=place, reverse=True)
    want, following = {}, {}
    for k, (i, t) in enumerate(order):
        other = order[(k + 1) % len(order)][1]
        cut = len(t) // 3
        want[i, t] = t[: len(t) - cut] + other[:cut]
        following[i, t] = other
    assert sorted(((r["doc_id"], r["n_chars"], r["edited"]) for r in rows), key=repr) == sorted(((i, len(t), want[i, t]) for i, t in texts), key=repr)
    names = {}
    for r in rows:
        assert len(r["f"]) == 8 * 8 + 60 * 16 + 8
    prints = {}
    for r, t in ((r, t) for r in rows for i, t in set(texts) if i == r["doc_id"] and want[i, t] == r["edited"] and len(t) == r["n_chars"]):
        prints.setdefault(t, set()).add(r["f"])
        names.setdefault(following[r["doc_id"], t], set()).add(r["n"])
    assert all(len(x) == 1 for x in prints.values())
    assert all(prints[t] == x for t, x in names.items() if t in prints)


def test_awkward_rows(awkward):
    df = awkward((2, "another text of the same id"), (11, "été 🎉\nzwei. drei"), (12, "été 🎉\nzwei. drei"), long_words=3000)
    check(df)
    check(df.where("doc_id = 7"))
    assert M.compare_with_edits(df.limit(0)).count() == 0


def test_query_is_native(spark):
    made = queries.QUERIES["op10_multiset_hash"](spark, "/root/testdata/sf0.001")
    assert not re.search("Python|Pandas|Arrow", made._jdf.queryExecution().toString())
    assert made.where("near_edited NOT BETWEEN 0 AND 1 OR near_next NOT BETWEEN 0 AND 1").count() == 0


def direct(text):
    """The vector in plain Python."""
    import struct

    import xxhash

    def h(x, k):
        return xxhash.xxh64_intdigest(struct.pack("<i", k), seed=xxhash.xxh64_intdigest(x.encode(), seed=42))

    lines = [x for x in (text or "").split("\n") if x]
    wide = [0] * 8
    for x in lines:
        for k in range(4):
            wide[2 * k] += h(x, k) & 0xFFFFFFFF
            wide[2 * k + 1] += h(x, k) >> 32
    parts = text or ""
    for mark in ".!?":
        parts = parts.replace(mark + " ", mark + "\n")
    parts = [x for x in parts.split("\n") if x]
    bits = [[sum(h(x, seed) >> k & 1 for x in parts) for k in range(60)] for seed in (101, 102)]
    return [x % 2**32 for x in wide] + [b[k] + (b[k + 30] << 32) for b in bits for k in range(30)] + [len(parts)]


def direct_likeness(a, b):
    if a == b:
        return 1.0
    one, two = ([s for x in v[8:68] for s in (2 * (x & 0x3FFFFFFF) - v[68], 2 * (x >> 32) - v[68])] for v in (a, b))
    size = (sum(x * x for x in one) * sum(x * x for x in two)) ** 0.5
    return min(1.0, max(0.0, sum(x * y for x, y in zip(one, two)) / size)) if size else 0.0


def test_fingerprints_and_likeness_against_direct_version(spark):
    rng = random.Random(10)
    pool = [f"sentence {k} é{rng.choice('.!?')}" for k in range(30)]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "\n\n"]) for _ in range(rng.randrange(25))) for _ in range(40)] + [None, "", "\n", "In. " * 3000]
    v = vectors(spark, texts)
    want = [direct(t) for t in texts]
    assert [v[k] for k in range(len(texts))] == want
    pairs = spark.createDataFrame([(k, v[k], v[(k + 1) % len(texts)]) for k in range(len(texts))], "k int, a array<long>, b array<long>")
    for k, near, print_ in pairs.select("k", M.likeness(F.col("a"), F.col("b")), M.as_string(F.col("a"))).collect():
        assert near == pytest.approx(direct_likeness(want[k], want[(k + 1) % len(texts)]))
        assert print_ == "".join(f"{x:0{8 if i < 8 or i == 68 else 16}x}" for i, x in enumerate(want[k]))


def test_many_equal_sentences_are_alike(spark):
    """Also with many others: the likeness needs the fingerprints alone."""
    others = " ".join(f"Other sentence {k}." for k in range(5000))
    df = spark.createDataFrame([(1, "In. " * 20_000), (2, "In. " * 12_000), (3, "In. " * 12_000 + others)], "doc_id long, text string")
    rows = M.compare_with_edits(df).select("doc_id", M.likeness(F.col("vector"), F.col("edited_vector")), M.likeness(F.col("vector"), F.col("next_vector"))).collect()
    assert {r[0] for r in rows if r[2] > 0.9} == {1, 2, 3} and {r[0] for r in rows if r[1] > 0.9} == {1, 2, 3}
