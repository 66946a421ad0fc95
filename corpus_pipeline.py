"""Documents to token ids: toxic documents go, near copies go, repeated and benchmark passages go, the rest is segmented.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of ``documents`` and returns a DataFrame; all but the
last return the same columns.  ``run`` writes each stage's result and reads it again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_audit.llm import decontaminate, golay_simhash, piece_nbest, toxicity, window_dedup
from corpus_audit.llm.common import stored, table
from corpus_audit.llm.queries import tokenizer

def _with_text(docs: DataFrame, changed: DataFrame, text: str) -> DataFrame:
    """The columns of ``docs`` from ``changed``, with another text and its length."""
    new = {"text": F.col(text).alias("text"), "n_chars": F.length(text).cast(dict(docs.dtypes).get("n_chars", "bigint")).alias("n_chars")}
    return changed.select(*[new.get(c, F.col(c)) for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose last category is at least ``toxicity.REJECT`` go; the model is fitted on the labels of ``docs``.

    Null and empty texts hold no term and stay; rows that repeat are judged alike."""
    chain = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, chain).where(F.col("p_toxic") < toxicity.REJECT).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest id stays.

    Rows without id all stay.  Of rows that repeat an id with different texts, each is judged by its own text; whole copies
    with the smallest id stay together.  Null, empty and blank texts are one group."""
    mark = F.xxhash64("text")
    groups = golay_simhash.simhash_groups(docs.select("doc_id", "text", mark.alias("mark")), carried=("mark",))
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark")).distinct()
    return docs.join(stored(gone, "gone"), (F.col("doc_id") == F.col("gone_id")) & (mark == F.col("gone_mark")), "left_anti")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of windows that also start in a document with a smaller id go.  Null, empty and short texts, and rows without
    id, stay as they are; so do documents that lose all their words, with an empty text."""
    return _with_text(docs, window_dedup.mark_repeats(docs), "kept_text")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows go; a document that they cover beyond the limit goes as a whole.  Null and empty texts stay."""
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    return _with_text(docs, marked.where(~F.col("over_limit")), "clean_text")


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_pieces, score, ids`` (little-endian 32-bit) of the best segmentation, ``other_scores`` of the next ones.  A
    null or empty text has no pieces and score 0."""
    made = piece_nbest.segment(docs.select("doc_id", "text"), tokenizer("piece_bpe_32k.model"))
    best = F.col("segmentations")[0]
    others = F.transform(F.slice("segmentations", 2, piece_nbest.N_BEST), lambda s: s["score"])
    return made.select("doc_id", best["n_pieces"].alias("n_pieces"), best["score"].alias("score"), best["ids"].alias("ids"), others.alias("other_scores"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("window_dedup", drop_repeats),
    ("decontaminate", drop_benchmark),
    ("pieces", to_pieces),
]

#: SQL expresses neither the classifier nor the segmentation; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
