"""Toxicity by a chain of linear classifiers.

Categories are predicted one after another.  Each is a regularised logistic model over the terms that a text
holds, and over the probabilities of all earlier categories.  For training, those probabilities come from
models that did not see the row (one of ``FOLDS`` parts is left out each time), as they would for a new text.

Labels only say toxic or not.  Unless categories are given, the toxic rows that are fitted are split into groups of rows that
share telling terms (spherical k-means); a link for each group is followed by one for the label itself.

Terms are words and, for languages that inflect them, their first 3 to 6 characters.  They are features if they
are much more frequent in a category and tell it from the rest beyond chance (log-likelihood ratio of document
counts, counted in Spark over the rows that are fitted; what chance can do depends on the number of terms).  All such terms
are used: rows are sparse, and Newton steps are solved by conjugate gradients, so memory grows with the terms that
rows hold.  A model is fitted on at most ``FIT_ROWS`` labelled rows, those whose hashed ids are smallest; every text is
scored whole.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import stored, text_batches, worker_cache, words_of

FIT_ROWS = 20_000
GROUPS = 3  # of toxic rows, where no categories are given
CHANCE = 0.05  # that any useless term has the evidence of a feature, whatever the number of rows and terms
TIMES = 3  # a feature is so many times as frequent in the category as in the rest, at least
FOLDS = 5
PENALTY = 1.0
STEMS = (3, 4, 5, 6)  # characters of a beginning; its term ends in "-"
REJECT = 0.5


@dataclass(frozen=True)
class Category:
    """Rows are positive if the label column is 1 and, where ``words`` are given, the text holds one of them."""

    name: str
    label: str
    words: frozenset[str] = frozenset()

    def of(self, label: int, words: set[str]) -> int:
        return int(label == 1 and (not self.words or not self.words.isdisjoint(words)))


def terms_of(text: str | None) -> set[str]:
    """The different words of a text and their beginnings; longer words have them all."""
    words = set(words_of(text))
    return words.union(*({w[:k] + "-" for w in words if len(w) > k} for k in STEMS))


@dataclass
class Link:
    """One model of the chain: weights of terms, then of earlier probabilities, and a constant."""

    name: str
    terms: dict[str, float] = field(default_factory=dict)
    earlier: list[float] = field(default_factory=list)
    constant: float = 0.0


def _sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


class Rows:
    """A matrix of 0 and 1 by the places of its ones, followed by dense columns."""

    def __init__(self, row: np.ndarray, column: np.ndarray, width: int, dense: np.ndarray):
        self.row, self.column, self.width, self.dense = row, column, width, dense
        self.shape = len(dense), width + dense.shape[1]

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.column], self.shape[0]) + self.dense @ w[self.width :]

    def across(self, u: np.ndarray) -> np.ndarray:
        """The transposed matrix times ``u``."""
        return np.concatenate((np.bincount(self.column, u[self.row], self.width), u @ self.dense))

    def diagonal(self, u: np.ndarray) -> np.ndarray:
        """Of the transposed matrix times the weights ``u`` times the matrix."""
        return np.concatenate((np.bincount(self.column, u[self.row], self.width), u @ (self.dense * self.dense)))

    def take(self, kept: np.ndarray) -> Rows:
        """The rows where ``kept``."""
        number, own = np.cumsum(kept) - 1, kept[self.row]
        return Rows(number[self.row[own]], self.column[own], self.width, self.dense[kept])


def _solved(x: Rows, bend: np.ndarray, ridge: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The Newton step, by conjugate gradients with the diagonal as preconditioner."""
    scale = 1.0 / (x.diagonal(bend) + ridge)
    step, rest = np.zeros(len(wanted)), wanted.copy()
    turned = scale * rest
    way, size = turned, rest @ turned
    least = 1e-20 * max(size, 1e-300)
    for _ in range(10 * len(wanted) + 10):
        if size <= least:
            break
        bent = x.across(bend * (x @ way)) + ridge * way
        far = size / (way @ bent)
        step, rest = step + far * way, rest - far * bent
        turned = scale * rest
        way, size = turned + (rest @ turned) / size * way, rest @ turned
    return step


def logistic(x: Rows | np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = PENALTY, rounds: int = 50) -> np.ndarray:
    """Weights by Newton steps, halved until they gain, with a ridge penalty; the last column of ``x`` is one, and its
    weight, the constant, has hardly any.  ``weight`` says how many rows each row stands for."""
    if isinstance(x, np.ndarray):
        x = Rows(np.empty(0, int), np.empty(0, int), 0, x)
    share = (weight @ y + 0.5) / (weight.sum() + 1.0)
    w = np.zeros(x.shape[1])
    w[-1] = math.log(share / (1 - share))
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3

    def loss(w):
        z = x @ w
        return weight @ (np.logaddexp(0, z) - y * z) + 0.5 * (ridge * w * w).sum()

    now = loss(w)
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        step = _solved(x, weight * p * (1 - p), ridge, x.across(weight * (y - p)) - ridge * w)
        while (then := loss(w + step)) > now and np.abs(step).max() > 1e-9:
            step = step / 2
        if now - then < 1e-9 * (1 + abs(now)):
            break
        w, now = w + step, then
    return w


def grouped(held: list[frozenset[str]], weight: np.ndarray, groups: int = GROUPS, rounds: int = 30) -> np.ndarray:
    """A group for each row by the terms it shares with others: spherical k-means from centres far apart; -1 for rows without
    terms.  Fewer groups where rows are too few or alike."""
    numbers = {t: k for k, t in enumerate(sorted(set().union(*held)))}
    own = [np.array(sorted(numbers[t] for t in row), int) for row in held]
    out = np.full(len(held), -1)
    filled = np.array([k for k, row in enumerate(own) if len(row)], int)
    if not len(filled):
        return out

    def unit(k):
        centre = np.zeros(len(numbers))
        centre[own[k]] = 1 / math.sqrt(len(own[k]))
        return centre

    def near(centres):
        return np.array([[centre[own[k]].sum() / math.sqrt(len(own[k])) for centre in centres] for k in filled])

    # The first centre is the row most like the mean, the next ones the rows least like those before.
    mean = sum(weight[k] * unit(k) for k in filled)
    centres = [unit(filled[int(near([mean])[:, 0].argmax())])]
    while len(centres) < groups:
        likest = near(centres).max(axis=1)
        if likest.min() > 1 - 1e-9:
            break
        centres.append(unit(filled[int(likest.argmin())]))
    last = None
    for _ in range(rounds):
        chosen = near(centres).argmax(axis=1)
        if last is not None and (chosen == last).all():
            break
        last = chosen
        for g in range(len(centres)):
            total = np.zeros(len(numbers))
            for k in filled[chosen == g]:
                total[own[k]] += weight[k] / math.sqrt(len(own[k]))
            centres[g] = total / (np.linalg.norm(total) or 1.0)
    out[filled] = last
    return out


def fit_links(
    held: list[frozenset[str]], folds: np.ndarray, weight: np.ndarray, targets: dict[str, np.ndarray], features: dict[str, list[str]]
) -> list[Link]:
    """The chain over rows in memory, in the order of ``targets``; what a row holds is a few terms."""
    chain, earlier = [], []
    for name, y in targets.items():
        chosen = features[name]
        number = {term: k for k, term in enumerate(chosen)}
        ones = [(k, number[t]) for k, row in enumerate(held) for t in row if t in number]
        row, column = np.array(ones, int).reshape(-1, 2).T
        x = Rows(row, column, len(chosen), np.column_stack([*earlier, np.ones(len(held))]))
        w = logistic(x, y, weight)
        chain.append(Link(name, dict(zip(chosen, w[: len(chosen)].tolist())), w[len(chosen) : -1].tolist(), float(w[-1])))
        unseen = np.empty(len(held))
        for k in range(FOLDS):
            out = folds == k
            if out.any():
                part = logistic(x.take(~out), y[~out], weight[~out]) if (~out).any() else w
                unseen[out] = _sigmoid(x.take(out) @ part)
        earlier.append(unseen)
    return chain


def _ratio(hit_pos, n_pos, hit, n):
    """Log-likelihood ratio of a word's document counts in and outside a category."""

    def term(k, m, share):
        return F.when(k > 0, k * F.log(k / (m * share))).otherwise(0.0)

    hit_neg, n_neg, share = hit - hit_pos, n - n_pos, hit / n
    ratio = term(hit_pos, n_pos, share) + term(n_pos - hit_pos, n_pos, 1 - share) + term(hit_neg, n_neg, share) + term(n_neg - hit_neg, n_neg, 1 - share)
    return 2 * ratio


def least_evidence(hits: dict[int, int], n_pos: int, n: int, chance: float = CHANCE) -> float:
    """The log-likelihood ratio that any useless term reaches with a probability of ``chance`` at most, where
    ``hits`` has the number of terms by their document counts.

    Useless terms have the ratios of a chi-squared distribution; ``chance`` is shared by the terms that are frequent
    enough to pass (Tarone): rarer ones fail even if all their documents are in the category.
    """
    rest, tested = n - n_pos, sum(hits.values())
    least = beyond = 0.0
    for hit in range(1, n_pos + 1):
        tested -= hits.get(hit - 1, 0)
        least = NormalDist().inv_cdf(chance / (2 * max(tested, 1))) ** 2
        missed, other = n_pos - hit, n - hit
        most = hit * math.log(n / n_pos) + (missed * math.log(missed * n / (n_pos * other)) if missed else 0.0)
        most = 2 * (most + (rest * math.log(n / other) if rest else 0.0))
        if most >= least:
            break
        beyond = most * (1 + 1e-9)  # so that no rarer term passes
    return max(least, beyond)


def fit(docs: DataFrame, labels: DataFrame, categories: list[Category] | None = None, fit_rows: int = FIT_ROWS, groups: int = GROUPS, label: str = "toxic") -> list[Link]:
    """Fit the chain on labelled documents.

    Without ``categories`` there is one for each of the ``groups`` of rows with ``label``, which ``grouped`` finds by their
    telling terms, and one for the label.  Rows without id, text or label are not fitted, nor labels without a document.
    A label row that repeats counts as often as it occurs.  Without labelled rows, or with one class alone, a
    category's model is a constant near its share.
    """
    derived = categories is None
    categories = categories or [Category(label, label)]
    text_batches(docs.sparkSession)
    columns = list(dict.fromkeys(c.label for c in categories))
    known = labels.select(F.col("doc_id").alias("label_id"), *columns).where(" AND ".join(f"{c} IS NOT NULL" for c in ["label_id", *columns]))
    # At most ``fit_rows`` short rows, so this side may be broadcast and no text is shuffled.
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id", *columns).limit(fit_rows)
    texts = docs.where("text IS NOT NULL").select("doc_id", "text")
    joined = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("label_id")).select("doc_id", "text", *columns)

    def each(batches):
        import pandas as pd

        worker_cache("toxicity")
        for b in batches:
            out = []
            for row in b.itertuples(index=False):
                terms = terms_of(row.text)
                out.append((int(row.doc_id), sorted(terms), [c.of(getattr(row, c.label), terms) for c in categories]))
            yield pd.DataFrame(out, columns=["doc_id", "terms", "targets"])

    rows = stored(joined.mapInPandas(each, "doc_id long, terms array<string>, targets array<int>"), "toxic-fit")
    n, *positive = rows.agg(F.count("*"), *[F.sum(F.col("targets")[k]) for k in range(len(categories))]).first()
    counts = rows.select(F.explode("terms").alias("term"), "targets").groupBy("term").agg(
        F.count("*").alias("hit"), *[F.sum(F.col("targets")[k]).alias(f"p{k}") for k in range(len(categories))]
    )
    hits = {r["hit"]: r["terms"] for r in counts.groupBy("hit").agg(F.count("*").alias("terms")).collect()}
    features: dict[str, list[str]] = {}
    for k, c in enumerate(categories):
        if n and 0 < (positive[k] or 0) < n:
            ratio = _ratio(F.col(f"p{k}").cast("double"), float(positive[k]), F.col("hit").cast("double"), float(n))
            telling = F.col(f"p{k}") * (n - positive[k]) >= TIMES * (F.col("hit") - F.col(f"p{k}")) * positive[k]
            best = counts.where(telling).select("term", ratio.alias("r")).where(F.col("r") >= least_evidence(hits, positive[k], n))
            features[c.name] = sorted(r["term"] for r in best.collect())  # no more than the terms of ``fit_rows`` rows
        else:
            features[c.name] = []
    used = sorted(set().union(*features.values()))
    # Rows that hold the same used terms count together: most hold none.  At most ``fit_rows`` of them.
    terms = F.array_sort(F.array_intersect("terms", F.array(*map(F.lit, used)))) if used else F.array().cast("array<string>")
    fold = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS).cast("int")
    kinds = rows.select(terms.alias("terms"), fold.alias("fold"), "targets").groupBy("terms", "fold", "targets").count()
    memory = [(frozenset(map(sys.intern, r["terms"])), r["fold"], r["targets"], r["count"]) for r in kinds.orderBy("terms", "fold", "targets").toLocalIterator()]
    targets = {c.name: np.array([t[k] for _, _, t, _ in memory], float) for k, c in enumerate(categories)}
    folds, weight = (np.array([r[k] for r in memory], float) for k in (1, 3))
    held = [r[0] for r in memory]
    if derived:
        positive_rows = np.flatnonzero(targets[label] == 1)
        group = np.full(len(held), -1)
        group[positive_rows] = grouped([held[k] for k in positive_rows], weight[positive_rows], groups) if len(positive_rows) else -1
        found = {f"group_{g + 1}": (group == g).astype(float) for g in range(groups)}
        features |= dict.fromkeys(found, features[label])
        targets = found | targets
    return fit_links(held, folds, weight, targets, features)


def chances(chain: list[Link], terms: set[str]) -> list[float]:
    """The probability of each category, in the order of the chain."""
    out: list[float] = []
    for link in chain:
        z = link.constant + sum(v for t, v in link.terms.items() if t in terms) + sum(v * p for v, p in zip(link.earlier, out))
        out.append(float(_sigmoid(z)))
    return out


def score(docs: DataFrame, chain: list[Link]) -> DataFrame:
    """``docs`` with ``p_<category>`` for each link.  Null and empty texts hold no words and get the probabilities of
    such a text.  Rows that repeat are scored alike; other columns pass through, those named like the results are
    replaced.  An empty table gives an empty result."""
    text_batches(docs.sparkSession)
    names = [f"p_{link.name}" for link in chain]
    vocabulary = frozenset(t for link in chain for t in link.terms)
    stems = [(k, frozenset(t[:-1] for t in vocabulary if len(t) == k + 1 and t[-1] == "-")) for k in STEMS]
    stems = [(k, known) for k, known in stems if known]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def scored(texts):
        import pandas as pd

        worker_cache("toxicity")
        seen: dict[frozenset, list[float]] = {}
        out = []
        for text in texts:
            words = set(words_of(text))
            held = vocabulary & words
            for k, known in stems:
                held |= {w[:k] + "-" for w in words if w[:k] in known and len(w) > k}
            if held not in seen:
                seen[held] = chances(chain, held)
            out.append(seen[held])
        return pd.DataFrame(out, columns=names)

    rows = docs.drop(*names)
    return rows.withColumn("__p", scored("text")).select(*[rows[c] for c in rows.columns], "__p.*")
