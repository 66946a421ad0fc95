"""Line dedup: against a direct version, on awkward rows, and the plan's parts."""

import random
import re

import pytest
from corpus_audit.llm import line_dedup as L
from corpus_audit.llm import queries

BLANK = " \t\n\x0b\x0c\r"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def direct(rows, min_chars=40, min_docs=5):
    """(doc_id, text) to sorted (doc_id, n_lines, n_dropped, kept text)."""
    holders = {}
    for i, t in rows:
        if i is not None and t is not None:
            for line in t.split("\n"):
                key = line.strip(BLANK).translate(LOW)
                if len(key) >= min_chars:
                    holders.setdefault(key, set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(h := holders.get(x.strip(BLANK).translate(LOW), ())) < min_docs or max(h) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def made(df, **how):
    rows = L.apply_bitmaps(df, L.keep_bitmaps(df, **how)).collect()
    for r in rows:
        lines = (r["text"] or "").split("\n")
        assert sum(k["n"] for k in r["keep"]) == r["n_lines"] - r["n_dropped"]
        assert "\n".join(x for k in r["keep"] for x in lines[k["start"] : k["start"] + k["n"]]) == r["kept_text"]
    return sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in rows), key=repr)


LONG = "A line that is long enough to count as one, Éè nº 1"


def test_awkward_rows(spark, awkward):
    extra = [(20 + k, f"{k}\n \t{LONG.upper() if k % 2 else LONG}\r\n\n{LONG}\nend {k}") for k in range(6)]
    extra += [(None, LONG), (25, LONG), (25, LONG), (30, f"{LONG}\n" * 2000 + "tail"), (31, LONG[:-1]), (32, ""), (33, "\n\n")]
    df = awkward(*extra)
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    assert made(df) == direct(rows)
    assert any(n for _, _, n, _ in direct(rows))


def test_random_texts(spark):
    rng = random.Random(13)
    pool = ["".join(rng.choice("ab ÄB\t") for _ in range(rng.randrange(6))) for _ in range(30)]
    rows = [(rng.randrange(40), "\n".join(rng.choice(pool) for _ in range(rng.randrange(9)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for how in ({"min_chars": 2, "min_docs": 3}, {"min_chars": 1, "min_docs": 1}, {"min_chars": 4, "min_docs": 8}):
        assert made(df, **how) == direct(rows, **how)


def test_empty_table_and_clashing_columns(spark):
    schema = "doc_id long, text string, keep string, n_lines string, hash string, mark string, drops string, first int, kept_text string"
    assert made(spark.createDataFrame([], schema)) == []
    rows = [(k, LONG, "k", "n", "h", "m", "d", 1, "t") for k in range(7)]
    out = L.apply_bitmaps(df := spark.createDataFrame(rows, schema), L.keep_bitmaps(df))
    assert sorted((r["doc_id"], r["n_dropped"], r["hash"], r["first"]) for r in out.collect()) == [(k, int(k < 6), "h", 1) for k in range(7)]


def test_plan_is_native_and_streams_first_lines(spark):
    df = spark.createDataFrame([(k, LONG) for k in range(9)], "doc_id long, text string")
    lines = L.line_hashes(df)._jdf.queryExecution().executedPlan().toString()
    assert lines.count("Exchange ") == 1 and "rangepartitioning" in lines and lines.count("Sort [") == 1
    assert "xxhash64" in lines.split("Generate")[1]  # the mark of a text is computed before its lines are spelled out
    plan = L.apply_bitmaps(df, L.keep_bitmaps(df))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_one_line_in_a_third_of_all_documents(spark):
    rows = [(k, f"{LONG}\nown {k}" if k % 3 == 0 else f"own {k}") for k in range(3000)]
    got = made(spark.createDataFrame(rows, "doc_id long, text string").repartition(16))
    assert got == direct(rows)


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_query_against_direct_version(spark, sf):
    import hashlib

    rows = [tuple(r) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = [(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in direct(rows)]
    assert sorted((tuple(r) for r in queries.QUERIES["op13_line_dedup"](spark, f"/root/testdata/{sf}").collect()), key=repr) == want
