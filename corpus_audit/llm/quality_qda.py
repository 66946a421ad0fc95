"""Document quality by regularised quadratic discriminant analysis.

A text becomes a vector of transformed statistics.  Each class has a mean and a covariance, shrunk towards the
covariance of both classes together and towards its diagonal; they come from sums over all labelled rows, which Spark
adds up.  The Cholesky factor of each covariance is kept with the model, so a log-density costs one triangular
product.  The difference of the two, mapped to a probability by a logistic curve fitted on its histogram, is the
score.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import stored, text_batches

SHRINK_TO_POOLED = 0.1
SHRINK_TO_DIAGONAL = 0.05
BIN = 0.25  # of log-density differences
CLIP = 60.0

FEATURES = (
    "chars words word_mean word_spread longest lines line_mean line_spread letters digits spaces upper beyond_ascii full_stops "
    "bars marks other_marks distinct_words common_word repeated_lines distinct_pairs entropy short_words capital_words"
).split()

_CLASS = np.zeros((256, 10))
for _k, _set in enumerate(
    (b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", bytes(range(128, 256)), b".!?", b"|", b"#$%&*@^~", b"<>{}[]()=+/\\_;:\"'`", b",")
):
    _CLASS[list(_set), _k] = 1.0


def _odds(share: float) -> float:
    return math.log((share + 1e-3) / (1 - share + 1e-3))


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of a text; a null or empty one has those of no characters at all."""
    text = text or ""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    words, lines = text.split(), [x for x in text.split("\n") if x]
    counts = np.bincount(data, minlength=256).astype(float)
    n, n_words, n_lines = max(1.0, counts.sum()), max(1, len(words)), max(1, len(lines))
    shares = counts @ _CLASS / n
    sizes, line_sizes = np.array([len(w) for w in words] or [0]), np.array([len(x) for x in lines] or [0])
    seen = Counter(words)
    chance = counts[counts > 0] / n
    return [
        math.log1p(len(text)),
        math.log1p(len(words)),
        math.log1p(sizes.mean()),
        math.log1p(sizes.std()),
        math.log1p(sizes.max()),
        math.log1p(len(lines)),
        math.log1p(line_sizes.mean()),
        math.log1p(line_sizes.std()),
        *[_odds(s) for s in shares[:9]],
        _odds(len(seen) / n_words),
        _odds(max(seen.values(), default=0) / n_words),
        _odds(1 - len(set(lines)) / n_lines if lines else 0.0),
        _odds(len(set(zip(words, words[1:]))) / max(1, len(words) - 1)),
        float(-(chance * np.log2(chance)).sum()) if len(chance) else 0.0,
        _odds(float((sizes <= 3).mean()) if words else 0.0),
        _odds(sum(w[0].isupper() for w in words) / n_words),
    ]


def with_statistics(docs: DataFrame) -> DataFrame:
    """``doc_id, x`` of every row."""

    def each(batches):
        for b in batches:
            b["x"] = [statistics(t) for t in b.pop("text")]
            yield b

    return docs.select("doc_id", "text").mapInPandas(each, f"doc_id {dict(docs.dtypes)['doc_id']}, x array<double>")


@dataclass
class Gaussian:
    """Mean, inverse Cholesky factor of the covariance, and the constant of the log-density."""

    mean: np.ndarray
    whiten: np.ndarray
    constant: float

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return self.constant - 0.5 * (((x - self.mean) @ self.whiten.T) ** 2).sum(axis=1)


@dataclass
class Model:
    """Standardisation, the two classes, and the curve from log-density differences to probabilities."""

    center: np.ndarray
    scale: np.ndarray
    classes: tuple[Gaussian, Gaussian] | None
    slope: float
    constant: float

    def differences(self, x: np.ndarray) -> np.ndarray:
        if self.classes is None:
            return np.zeros(len(x))
        z = (x - self.center) / self.scale
        bad, good = (g.log_density(z) for g in self.classes)
        return np.clip(good - bad, -CLIP, CLIP)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * self.differences(x) + self.constant, -35, 35)))


def _gaussian(n: float, total: np.ndarray, outer: np.ndarray, pooled: np.ndarray, to_pooled: float, to_diagonal: float) -> Gaussian:
    mean = total / n
    own = outer / n - np.outer(mean, mean)
    cov = (1 - to_pooled) * own + to_pooled * pooled
    cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + 1e-4 * np.eye(len(cov))
    factor = np.linalg.cholesky(cov)
    whiten = np.linalg.solve(factor, np.eye(len(cov)))
    return Gaussian(mean, whiten, -float(np.log(np.diag(factor)).sum()))


def _moments(rows: DataFrame, size: int) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products for each class; each batch sends one row a class."""

    def each(batches):
        import pandas as pd

        for b in batches:
            out = []
            for label, part in b.groupby("label"):
                x = np.vstack(part["x"].to_numpy())
                out.append((int(label), np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))))
            yield pd.DataFrame(out, columns=["label", "m"])

    length = 1 + size + size * size
    sums = [F.sum(F.col("m")[k]) for k in range(length)]
    found = rows.mapInPandas(each, "label int, m array<double>").groupBy("label").agg(F.array(*sums).alias("m"))
    made = {r["label"]: np.array(r["m"]) for r in found.collect()}
    return {k: (m[0], m[1 : 1 + size], m[1 + size :].reshape(size, size)) for k, m in made.items()}


def fit(rows: DataFrame, to_pooled: float = SHRINK_TO_POOLED, to_diagonal: float = SHRINK_TO_DIAGONAL) -> Model:
    """A model from ``x, label`` (0 or 1; other rows are left out).  With one class or no rows at all, every score
    is the share of label 1 (one half without rows)."""
    rows = rows.where("label IN (0, 1)").select("x", F.col("label").cast("int").alias("label"))
    size = len(FEATURES)
    found = _moments(rows, size)
    n = sum(m[0] for m in found.values())
    if set(found) != {0, 1} or min(m[0] for m in found.values()) < 2:
        share = (found[1][0] if 1 in found else 0.0) / n if n else 0.5
        return Model(np.zeros(size), np.ones(size), None, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    center = sum(m[1] for m in found.values()) / n
    spread = np.sqrt(np.maximum(np.diag(sum(m[2] for m in found.values())) / n - center**2, 1e-8))
    scaled = {}
    for k, (count, total, outer) in found.items():
        shift = outer - np.outer(total, center) - np.outer(center, total) + count * np.outer(center, center)
        scaled[k] = count, (total - count * center) / spread, shift / np.outer(spread, spread)
    within = sum(o - np.outer(t, t) / c for c, t, o in scaled.values()) / n
    classes = tuple(_gaussian(*scaled[k], within, to_pooled, to_diagonal) for k in (0, 1))
    model = Model(center, spread, classes, 1.0, math.log(scaled[1][0] / scaled[0][0]))
    return _calibrated(model, rows)


def _calibrated(model: Model, rows: DataFrame) -> Model:
    """Fit the curve on the histogram of differences: a few hundred bins, however many rows."""

    def each(batches):
        for b in batches:
            yield b[["label"]].assign(bin=np.round(model.differences(np.vstack(b["x"].to_numpy())) / BIN).astype(int) if len(b) else [])

    bins = rows.mapInPandas(each, "label int, bin int").groupBy("bin", "label").count().orderBy("bin", "label").collect()
    d, y, w = (np.array([f(r) for r in bins], float) for f in (lambda r: r["bin"] * BIN, lambda r: r["label"], lambda r: r["count"]))
    weights = _weighted_logistic(d[:, None], y, w)
    return Model(model.center, model.scale, model.classes, max(1e-3, float(weights[0])), float(weights[1]))


def _weighted_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 50) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(2)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -35, 35)))
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - 1e-3 * w)
        w += np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id) -> F.Column:
    """One document in five, by its id's text; a row without id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """``doc_id, held_out, score`` of every row of ``doc_id, text``; other columns are no input.

    Learns from labels of documents that are not held out.  Null and empty texts are scored as texts without
    characters.  Null labels teach nothing; label rows that repeat count as often.  Rows that repeat a doc_id are
    scored each by its text.  An empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    rows = stored(with_statistics(docs.select("doc_id", "text")), "statistics")
    known = labels.select("doc_id", F.col(label).alias("label")).where(~held_out(F.col("doc_id")))
    model = fit(rows.join(known, "doc_id").select("x", "label"))

    @F.pandas_udf("double")
    def scored(x):
        import pandas as pd

        return pd.Series(model.scores(np.vstack(x.to_numpy())) if len(x) else [])

    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored("x").alias("score"))
