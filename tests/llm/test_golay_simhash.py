"""SimHash groups against all pairs, and the Golay keys against the code's definition."""

import random

import numpy as np
from corpus_audit.llm import components as C
from corpus_audit.llm import golay_simhash as G


def fingerprint(text):
    from xxhash import xxh64_intdigest

    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    hashes = [xxh64_intdigest(" ".join(words[k : k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest_reachable(marks):
    parent = {i: i for i in marks}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in marks:
        for j in marks:
            if i < j and any((a ^ b).bit_count() <= 3 for a in marks[i] for b in marks[j]):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in marks}


def check(df, result):
    marks = {}
    for r in df.collect():
        if r["doc_id"] is not None:
            marks.setdefault(r["doc_id"], set()).add(fingerprint(r["text"]))
    want, rows = smallest_reachable(marks), result.collect()
    assert len(rows) == df.count() and result.columns == ["doc_id", "fingerprint", "component_id"]
    for r in rows:
        if r["doc_id"] is not None:
            assert r["component_id"] == want[r["doc_id"]], r
    assert sorted(r["fingerprint"] for r in rows) == sorted(f"{fingerprint(r['text']):016x}" for r in df.collect())


def test_code_is_perfect():
    code = G.golay()
    words = np.arange(1 << 23, dtype=np.int64)[:: 97]
    index = code.index(words)
    assert index.min() >= 0 and index.max() < 4096
    # Words within 3 bits of a word that decodes without error have its index.
    rng = np.random.default_rng(1)
    for centre in words[code.error[G._syndromes(words)] == 0][:200]:
        flips = np.array([sum(1 << int(b) for b in rng.choice(23, 3, replace=False)) for _ in range(20)])
        assert set(code.index(centre ^ flips)) == set(code.index(np.array([centre])))


def test_keys_meet_within_three_bits():
    rng = random.Random(2)
    for _ in range(2000):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randrange(4)):
            b ^= 1 << bit
        a, b = (np.array([x], np.uint64).view(np.int64) for x in (a, b))
        assert set(G.asked_keys(a)[0].tolist()) & set(G.offered_keys(b)[0].tolist())


def test_groups(spark, awkward):
    df = awkward((11, "one"), (12, "ONE\n"))
    check(df, G.simhash_groups(df))
    check(df, G.simhash_groups(df, hot_key=0))
    assert G.simhash_groups(df.limit(0)).count() == 0


def test_links_of_dense_fingerprints(spark):
    """Many fingerprints around few centres, in both ways of linking."""
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            f = centre
            for bit in rng.sample(range(64), rng.randrange(6)):
                f ^= 1 << bit
            fps.add(f)
    nodes = {i: {f} for i, f in enumerate(sorted(fps))}
    want = smallest_reachable(nodes)
    df = spark.createDataFrame([(i, int(np.uint64(next(iter(f))).view(np.int64))) for i, f in nodes.items()], "node long, fp long")
    for hot in (10**6, 3, 0):
        found = dict(C.components(G.links(df, hot)).collect())
        assert {i: found.get(i, i) for i in nodes} == want, hot


def test_long_path_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(0, 200)] + [(500, 501), (501, 500), (7, 7)], "a long, b long")
    found = dict(C.components(edges).collect())
    assert {found[k] for k in range(201)} == {0} and found[501] == 500
