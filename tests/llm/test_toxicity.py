"""The chain on texts whose markers are known, held out rows included."""

import random

import numpy as np
import pytest
from corpus_audit.llm import toxicity as T

CLEAN = [f"w{k}" for k in range(400)]
CATEGORIES = [T.Category("insult", "toxic", frozenset({"dolt"})), T.Category("toxic", "toxic")]


def table(spark, n, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words, toxic = rng.choices(CLEAN, k=60), int(rng.random() < 0.15)
        if toxic:
            kind = rng.random()
            words += ["dolt", "Dolt"] if kind < 0.4 else [f"grum{rng.randrange(10**6)}" for _ in range(2)]
        rng.shuffle(words)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows(spark):
    docs, labels = table(spark, 3000, 1)
    chain = T.fit(docs, labels.where("doc_id % 4 <> 0"), CATEGORIES)
    scored = T.score(docs.where("doc_id % 4 = 0"), chain).join(labels, "doc_id").collect()
    assert [link.name for link in chain] == ["insult", "toxic"] and len(chain[1].earlier) == 1
    assert all((r["p_toxic"] >= T.REJECT) == bool(r["toxic"]) for r in scored)
    assert all(r["p_insult"] > 0.5 for r in scored if "dolt" in r["text"].lower().split())
    # The same as the plain sum over the terms of a text.
    for r in scored[:50]:
        assert T.chances(chain, T.terms_of(r["text"])) == pytest.approx([r["p_insult"], r["p_toxic"]])


def test_awkward_rows(spark, awkward):
    df = awkward()
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (None, 1), (99, 1), (4, None)], "doc_id long, toxic int")
    scored = T.score(df, T.fit(df, labels, CATEGORIES))
    assert scored.count() == df.count() and scored.columns == [*(c for c in df.columns if c != "p_toxic"), "p_insult", "p_toxic"]
    assert scored.where("p_toxic NOT BETWEEN 0 AND 1 OR p_toxic IS NULL").count() == 0
    for some in (labels.where("toxic = 0"), labels.limit(0)):
        chain = T.fit(df, some, CATEGORIES)
        assert all(not link.terms and 0 < T.chances([link], set())[0] < 0.5 + 1e-9 for link in chain)
    assert T.score(df.limit(0), T.fit(df.limit(0), labels, CATEGORIES)).count() == 0


def test_logistic_weighs_rows():
    x, y = np.array([[0.0, 1.0], [1.0, 1.0], [1.0, 1.0]]), np.array([0.0, 1.0, 0.0])
    whole = T.logistic(np.repeat(x, [30, 8, 2], axis=0), np.repeat(y, [30, 8, 2]), np.ones(40))
    assert np.allclose(whole, T.logistic(x, y, np.array([30.0, 8.0, 2.0])), atol=1e-4)


def direct_logistic(x, y, weight):
    """Newton steps with the whole matrix."""
    share = (weight @ y + 0.5) / (weight.sum() + 1)
    w = np.zeros(x.shape[1])
    w[-1] = np.log(share / (1 - share))
    ridge = np.full(len(w), T.PENALTY)
    ridge[-1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-(x @ w)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), x.T @ (weight * (y - p)) - ridge * w)
        w = w + step * min(1, 2 / (np.abs(step).max() + 1e-12))
    return w


def test_chain_against_direct_version():
    """Sparse rows and conjugate gradients give the weights of dense ones; earlier links are fed with what models said that
    did not see the row."""
    rng = np.random.default_rng(3)
    terms = [f"t{k}" for k in range(12)]
    held = [frozenset(t for t in terms if rng.random() < 0.25) for _ in range(150)]
    weight, folds = rng.integers(1, 4, 150).astype(float), rng.integers(0, T.FOLDS, 150).astype(float)
    targets = {"a": np.array([float("t1" in h or rng.random() < 0.1) for h in held]), "b": np.array([float(len(h) > 3) for h in held])}
    targets["c"] = np.maximum(targets["a"], targets["b"])
    features = {"a": terms[:6], "b": terms, "c": terms[3:]}
    chain, earlier = T.fit_links(held, folds, weight, targets, features), []
    for link, (name, y) in zip(chain, targets.items()):
        x = np.column_stack([[[float(t in h) for t in features[name]] for h in held], *earlier, np.ones(150)])
        want = direct_logistic(x, y, weight)
        assert link.name == name and np.allclose([*link.terms.values(), *link.earlier, link.constant], want, atol=1e-3)
        unseen = np.empty(150)
        for k in range(T.FOLDS):
            out = folds == k
            unseen[out] = 1 / (1 + np.exp(-(x[out] @ direct_logistic(x[~out], y[~out], weight[~out]))))
        earlier.append(unseen)
    assert [len(link.earlier) for link in chain] == [0, 1, 2]


def test_groups_share_terms():
    held = [frozenset(f"{g}{k}" for k in range(3) if (n + k) % 4) for n in range(20) for g in "abc"] + [frozenset()] * 5
    group = T.grouped(held, np.ones(len(held)))
    assert set(group[-5:]) == {-1} and len({group[k] for k in range(3)}) == 3
    assert all(group[k] == group[k % 3] for k in range(60))
    assert set(T.grouped([frozenset("x")] * 4, np.ones(4))) == {0} and set(T.grouped([frozenset()], np.ones(1))) == {-1}


def test_groups_are_links_before_the_label(spark):
    docs, labels = table(spark, 1500, 2)
    chain = T.fit(docs, labels)
    assert [link.name for link in chain] == ["group_1", "group_2", "group_3", "toxic"] and len(chain[-1].earlier) == 3
    scored = T.score(docs, chain).join(labels, "doc_id").collect()
    assert sum((r["p_toxic"] >= T.REJECT) == bool(r["toxic"]) for r in scored) >= 0.99 * len(scored)


def test_no_number_of_terms_is_a_limit(spark):
    """More telling terms than any fixed number: all are features."""
    rows = [(k, " ".join([f"bad{(k * 7 + j) % 400}" for j in range(60)] if k % 4 == 0 else [f"w{(k * 3 + j) % 500}" for j in range(60)])) for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k, _ in rows], "doc_id long, toxic int")
    chain = T.fit(docs, labels)
    assert len({t for t in chain[-1].terms if not t.endswith("-")}) == 400


def rejected(spark, folder, rows):
    """Rejected and all labelled toxic rows by language, and the same of all others, for the first labelled rows."""
    labels = spark.read.parquet(f"{folder}/labels.parquet").orderBy("doc_id").limit(rows)
    docs = spark.read.parquet(f"{folder}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    chain = T.fit(docs, labels)
    found = {}
    for r in T.score(docs, chain).join(labels, "doc_id").collect():
        gone, n = found.get((r["toxic"], r["lang"]), (0, 0))
        found[r["toxic"], r["lang"]] = gone + (r["p_toxic"] >= T.REJECT), n + 1
    return chain, found


def test_small_tables_have_features(spark):
    chain, found = rejected(spark, "/root/testdata/sf0.001", 1000)
    assert all(link.terms for link in chain)
    gone, n = found[1, "en"]
    assert gone > n / 2 and sum(gone for (toxic, _), (gone, _) in found.items() if not toxic) == 0


def test_languages_have_features(spark):
    _, found = rejected(spark, "/root/testdata/sf0.1", 500)
    for lang in ("en", "de", "fr"):  # two toxic rows are Spanish: too few to tell their words
        gone, n = found[1, lang]
        assert gone > 0.8 * n, lang


def test_evidence_grows_with_terms_alone():
    assert T.least_evidence({5: 1000}, 50, 500) == T.least_evidence({500: 1000}, 5000, 50_000)
    assert T.least_evidence({5: 10}, 50, 500) < T.least_evidence({5: 10**6}, 50, 500) < 45
    assert T.least_evidence({1: 10**6, 5: 10}, 50, 500) == T.least_evidence({5: 10}, 50, 500)
