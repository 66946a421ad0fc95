"""Merkle manifest: trees, witnesses and tampering against a direct version."""

from hashlib import sha256

import pytest
from corpus_audit.llm import merkle as M
from corpus_audit.llm import queries
from pyspark.sql import functions as F


def h(s):
    return sha256(s.encode()).hexdigest()


def leaf(*values):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(digests):
    """Root, and each leaf's [(index in run, run's others)]."""
    paths, under, nodes = [[] for _ in digests], [[k] for k in range(len(digests))], digests
    while len(nodes) > 1:
        runs = [range(k, min(k + 8, len(nodes))) for k in range(0, len(nodes), 8)]
        for run in runs:
            for k in run:
                for x in under[k]:
                    paths[x].append((k - run[0], "".join(nodes[o] for o in run if o != k)))
        under = [[x for k in run for x in under[k]] for run in runs]
        nodes = [h("".join(nodes[k] for k in run)) for run in runs]
    return nodes[0], paths


def direct(rows):
    """(doc_id, source, lang, n_chars, text) rows to sorted (doc_id, leaf, subroot, root, witness)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r[0]))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in langs}
    root, tops = tree([trees[g][0] for g in langs]) if langs else (None, [])
    return sorted(
        ((x[3], x[2], trees[g][0], root, tuple(path + tops[k])) for k, g in enumerate(langs) for x, path in zip(sorted(groups[g]), trees[g][1])), key=repr
    )


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def made(df, **how):
    out = M.manifest(df, **how).collect()
    return sorted(((r["doc_id"], r["leaf"], r["subroot"], r["root"], tuple((s["at"], s["siblings"]) for s in r["witness"])) for r in out), key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 63, 64, 65, 520])
def test_streamed_tree(n):
    digests = [h(str(k)) for k in range(n)]
    if not n:
        assert M.height_of(0) == 0
        return
    t = M.Tree(M.height_of(n))
    nodes = [t.append(d) for d in digests]
    root = t.finish()
    want, paths = tree(digests)
    assert root == want and [[(s["at"], s["siblings"]) for s in M.path_of(x)] for x in nodes] == paths


def test_partial_witnesses_grow_with_later_siblings():
    t = M.Tree(2)
    first = t.append(h("0"))
    assert first.siblings == []
    t.append(h("1"))
    assert first.siblings == [h("1")] and first.parent is None
    for k in range(2, 8):
        t.append(h(str(k)))
    assert first.siblings == [h(str(k)) for k in range(1, 8)] and first.parent.siblings == []
    for k in range(8, 16):
        t.append(h(str(k)))
    assert len(first.parent.siblings) == 1


def test_awkward_rows(spark):
    rows = [(k, "web" if k % 3 else None, ["en", "de", None, "É", "z"][k % 5], k if k % 4 else None, None if k % 7 == 0 else "Text É " * (k % 3)) for k in range(300)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "a", "en", 1, "x")] * 20 + [(5, "b", "en", 1, "x"), (1, "s", "solo", 0, ""), (7, "s", "", 0, "x" * 300_000)]
    rows += [(k, "s", f"l{k}", 1, "t") for k in range(70)]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"digest": F.lit(1), "grp": F.lit("g"), "rank": F.lit("r"), "path": F.lit(0)}).repartition(5)
    assert made(df) == direct(rows)


def test_blocks_of_blocks(spark):
    """Small blocks, so that trees need several rounds; one group holds nearly all rows."""
    rows = [(k, "s", "en" if k % 50 else "fr", k, f"text {k}") for k in range(1100)] + [(k, "s", f"g{k:03}", 1, "t") for k in range(90)]
    assert made(spark.createDataFrame(rows, SCHEMA).repartition(7), levels=1) == direct(rows)


def test_more_rows_than_a_block(spark):
    rows = [(k, "s", "en", k, "t") for k in range(8**M.LEVELS + 3)] + [(k, "s", "de", k, "t") for k in range(8**M.LEVELS)]
    assert made(spark.createDataFrame(rows, SCHEMA)) == direct(rows)


def test_empty_table(spark):
    assert made(spark.createDataFrame([], SCHEMA)) == []


def test_query_finds_tampering(spark):
    from zlib import crc32

    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.QUERIES["op12_merkle"](spark, sf).collect()
    want = {r[0]: r for r in direct([(d["doc_id"], d["source"], d["lang"], d["n_chars"], d["text"]) for d in docs.values()])}
    assert len(rows) == len(docs)
    for r in rows:
        doc, (_, lf, subroot, root, path) = docs[r["doc_id"]], want[r["doc_id"]]
        text = doc["text"]
        if crc32(str(r["doc_id"]).encode()) % 3 == 0:
            text = text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        fold = leaf(doc["doc_id"], doc["source"], doc["lang"], doc["n_chars"], text)
        for at, others in path:
            fold = h(others[: 64 * at] + fold + others[64 * at :])
        assert tuple(r) == (r["doc_id"], lf, subroot, root, h("".join(o for _, o in path)), fold, fold == root)
    assert 0 < sum(not r["verified"] for r in rows) < len(rows)
