"""The discriminant against direct densities, and held-out accuracy."""

import random
from zlib import crc32

import numpy as np
import pytest
from corpus_audit.llm import quality_qda as Q


def text(rng, good):
    words = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(20, 90))]
    if good:
        return ". ".join(" ".join(words[k : k + 8]).capitalize() for k in range(0, len(words), 8))
    return rng.choice([" | ".join(words), " ".join(w + "$$$" for w in words), "\n".join(words[:3] * 20)])


def test_held_out_accuracy(spark):
    rng = random.Random(1)
    rows = [(i, text(rng, i % 6 != 0)) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 6 != 0)) for i, _ in rows], "doc_id long, quality int")
    scored = Q.score_quality(docs, labels).collect()
    assert all(r["held_out"] == (crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in scored)
    held = [r for r in scored if r["held_out"]]
    assert sum((r["score"] >= 0.3) == (r["doc_id"] % 6 != 0) for r in held) >= 0.97 * len(held)
    # Labels of held-out documents change nothing.
    other = Q.score_quality(docs, labels.selectExpr("doc_id", "IF(crc32(cast(doc_id AS string)) % 5 = 0, 1 - quality, quality) AS quality"))
    assert {(r["doc_id"], round(r["score"], 6)) for r in other.collect()} == {(r["doc_id"], round(r["score"], 6)) for r in scored}


def test_density_is_that_of_the_shrunk_covariance(spark):
    rng = np.random.default_rng(2)
    size = len(Q.FEATURES)
    x = rng.normal(size=(400, size)) @ rng.normal(size=(size, size)) * 0.2
    y = (np.arange(400) % 3 > 0).astype(int)
    x[y == 0] *= 1.7
    rows = spark.createDataFrame([(a.tolist(), int(b)) for a, b in zip(x, y)], "x array<double>, label int").repartition(3)
    model = Q.fit(rows)
    z = (x - x.mean(0)) / x.std(0)
    within = sum((y == k).sum() * np.cov(z[y == k].T, bias=True) for k in (0, 1)) / len(y)
    logs = []
    for k in (0, 1):
        c = (1 - Q.SHRINK_TO_POOLED) * np.cov(z[y == k].T, bias=True) + Q.SHRINK_TO_POOLED * within
        c = (1 - Q.SHRINK_TO_DIAGONAL) * c + Q.SHRINK_TO_DIAGONAL * np.diag(np.diag(c)) + 1e-4 * np.eye(size)
        d = z - z[y == k].mean(0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) + np.linalg.slogdet(c)[1]))
    assert model.differences(x) == pytest.approx(np.clip(logs[1] - logs[0], -Q.CLIP, Q.CLIP), abs=1e-6)


def test_awkward_rows(spark, awkward):
    df = awkward()
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (3, 1), (4, 0), (5, 0), (6, 1), (7, None), (None, 1), (8, 1)], "doc_id long, quality int")
    for some in (labels, labels.where("quality = 1"), labels.limit(0)):
        got = Q.score_quality(df, some)
        assert got.columns == ["doc_id", "held_out", "score"] and got.count() == df.count()
        assert got.where("score IS NULL OR score NOT BETWEEN 0 AND 1 OR held_out IS NULL").count() == 0
    assert Q.score_quality(df.limit(0), labels).count() == 0
