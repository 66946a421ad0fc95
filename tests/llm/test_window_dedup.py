"""Window removal against a dictionary of all windows."""

import random
import re

from corpus_audit.llm import window_dedup as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def removed(rows, window):
    first = {}
    for i, text in rows:
        if i is not None:
            words = WORD.findall(text or "")
            for k in range(len(words) - window + 1):
                key = tuple(words[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for k in range(len(words) - window + 1) if i is not None else ():
            if first[tuple(words[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), [w for k, w in enumerate(words) if k not in gone], text))
    return out


def check(df, window):
    result = W.mark_repeats(df, window)
    got = sorted(
        ((r["doc_id"], r["n_words"], r["n_removed"], WORD.findall(r["kept_text"] or "")) for r in result.collect()), key=repr
    )
    want = sorted(((a, b, c, d) for a, b, c, d, _ in removed([(r["doc_id"], r["text"]) for r in df.collect()], window)), key=repr)
    assert got == want
    for r in result.collect():
        if r["n_removed"] == 0:
            assert r["kept_text"] == r["text"]
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["removed"])


def test_awkward_rows(awkward):
    df = awkward((2, "another text of the same id " * 30), (11, "another text of the same id " * 30))
    check(df, 50)
    check(df, 7)
    assert W.mark_repeats(df.limit(0)).count() == 0
    assert set(df.columns) <= set(W.mark_repeats(df).columns)


def test_shared_passages(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(3000)]
    passages = [" ".join(rng.choices(words, k=rng.randrange(40, 140))) for _ in range(12)]
    rows = []
    for i in range(120):
        parts = [" ".join(rng.choices(words, k=rng.randrange(0, 80))) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(passages))
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(parts)))
    rows += [(200 + k, rows[k][1]) for k in range(40)]
    rows.append((300, "same " * 400))
    rows.append((301, "same " * 100))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 50)


def test_hashes_tell_words_apart():
    texts = ["ab c", "a bc", "a b c", "abc", "c ab", "", "  ", "a\x00b", "a b\x00", "a\u00a0b", "a\x1cb"]
    seen = {}
    for t in texts:
        data = t.encode()
        hashes = W.word_hashes(data)
        assert hashes.shape == (2, len(WORD.findall(t))) and len(W.word_bounds(data)[0]) == hashes.shape[1]
        words = tuple(WORD.findall(t))
        assert seen.setdefault(tuple(map(tuple, hashes.tolist())), words) == words
    assert W.merged(__import__("numpy").array([0, 5, 100]), 10) == [(0, 15), (100, 110)]


def test_words_that_defeat_polynomials(spark):
    """A Thue-Morse word and its complement have one polynomial modulo 2^64, whatever the base."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, "x " * 49 + word), (2, "x " * 49 + other), (3, "x " * 49 + word), (4, " ".join([word, other] * 30)), (5, " ".join([other, word] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, 50)
    assert {r["doc_id"]: r["n_removed"] for r in W.mark_repeats(df).collect()} == {1: 0, 2: 0, 3: 50, 4: 0, 5: 60}


def test_long_texts_are_hashed_in_blocks(monkeypatch):
    import numpy as np

    hashes = np.random.default_rng(8).integers(0, 1 << 63, 1000).astype(np.uint64)
    whole = W.gram_hashes(hashes, 50)
    monkeypatch.setattr(W, "BLOCK", 64)
    assert (W.gram_hashes(hashes, 50) == whole).all() and len(whole) == 951
