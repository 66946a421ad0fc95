"""The automaton's hits against a search for every window."""

import random

from corpus_audit.llm import decontaminate as D
from corpus_audit.llm.common import words_of


def brute(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for item, item_text in items:
        w = words_of(item_text)
        if item is None or not w:
            continue
        k = min(window, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit.update(range(i, i + k))
                found.add(str(item))
    return len(words), sorted(hit), sorted(found)


ITEMS = [
    (1, "the of and to in a is that for it was as with"),
    (2, "the of and"),
    (3, "of and"),
    (4, "and"),
    (5, None),
    (6, "..."),
    (7, "it was as with be on not this are or from the of"),
    (8, "X the Of And"),
    (9, "of and the of and the of and the of and the of and"),
    (10, "the of and to in a is that for it"),
    (10, "the of and to in a is that for it"),
    (None, "to in a"),
]


def check(spark, df, items, window, **options):
    table = spark.createDataFrame(items, "item_id long, text string")
    rows = D.mark_contamination(df, table, window, **options).collect()
    assert len(rows) == df.count()
    for r in rows:
        n, hit, found = brute(r["text"], items, window)
        got = sorted(p for s in r["spans"] for p in range(s["start"], s["end"]))
        assert (r["n_words"], got, r["items"], r["n_hit"]) == (n, hit, found, len(hit)), r["text"]
        kept = [w for k, w in enumerate(words_of(r["text"])) if k not in set(hit)]
        assert words_of(r["clean_text"]) == kept and (r["text"] is None) == (r["clean_text"] is None)


def test_awkward_rows(spark, awkward):
    df = awkward((11, "so THE of, and to in a is that for it was as with it"), long_words=500)
    check(spark, df, ITEMS, 10)
    check(spark, df, ITEMS, 3, block_bytes=40)  # several blocks
    check(spark, df, [], 10)
    assert D.mark_contamination(df.limit(0), df.selectExpr("doc_id AS item_id", "text"), 10).count() == 0


def test_random_texts():
    rng = random.Random(6)
    for _ in range(300):
        letters = "abc"[: rng.randrange(1, 4)]
        items = [(k, " ".join(rng.choices(letters, k=rng.randrange(0, 9)))) for k in range(rng.randrange(1, 6))]
        window = rng.randrange(1, 6)
        automaton = D.ItemAutomaton([(str(i), words_of(t)) for i, t in items], window)
        for _ in range(5):
            text = " ".join(rng.choices(letters + "d", k=rng.randrange(0, 25)))
            spans, found = automaton.match(words_of(text))
            n, hit, names = brute(text, items, window)
            assert sorted(p for a, z in spans for p in range(a, z)) == hit, (text, items, window)
            assert sorted(automaton.items[i] for i in found) == names, (text, items, window)


def test_texts_go_to_python_once(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    marked = D.mark_contamination(df, spark.createDataFrame([("i", "a b")], "item_id string, text string"))
    plan = marked.where("NOT over_limit").select("doc_id", "clean_text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
