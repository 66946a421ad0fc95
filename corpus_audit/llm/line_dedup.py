"""Removal of lines that many documents hold, by SQL functions alone; results are keep bitmaps, not texts.

A line's key is the line without the blanks ``[\\x20\\x09-\\x0D]`` at its ends, A-Z lower-cased.  Keys of enough
characters become 128-bit hashes, one narrow row a line.  These are partitioned by ranges of hash and document and
sorted by hash, document and position, so that every partition streams its first occurrences: the first row of a
hash in a document says that the document holds it.  A hash that a third of all lines share is cut between documents
and spread over many partitions; its first occurrences are counted inside them before anything is exchanged.

What a document keeps is a bitmap of its lines, stored as runs (``start, n``): a few bytes a document, whatever
its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_audit.llm.common import lower_ascii, stored

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\v\f\r"


def split_lines(text) -> F.Column:
    """The lines of a text, at least one; null has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line) -> F.Column:
    return lower_ascii(F.btrim(line, F.lit(BLANKS)))


def _text_mark(text) -> F.Column:
    """Tells apart the texts of rows that repeat an id."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_hashes(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """``hash, doc_id, mark, pos, first``: the lines whose keys are long enough, partitioned by ranges of hash and
    document and sorted by position too; ``first`` marks the first line of a hash in a document."""
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), _text_mark(F.col("text")).alias("mark"), "text")  # once a text, not a line
    lines = rows.select("doc_id", "mark", F.posexplode(split_lines(F.col("text"))).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= min_chars).select("doc_id", "mark", "pos", line_key(F.col("line")).alias("key"))
    hashed = keyed.where(F.length("key") >= min_chars).select(F.unhex(F.md5("key")).alias("hash"), "doc_id", "mark", "pos")
    ranged = hashed.repartitionByRange("hash", "doc_id").sortWithinPartitions("hash", "doc_id", "mark", "pos")
    # The window needs rows together by hash and document, in order: as they are, so it adds no exchange and no sort.
    nth = F.row_number().over(Window.partitionBy("hash", "doc_id").orderBy("mark", "pos"))
    return ranged.withColumn("first", nth == 1)


def _runs(drops, n_lines) -> F.Column:
    """Runs of kept lines between sorted positions of dropped ones."""
    ends = F.filter(drops, lambda p, i: F.coalesce(F.get(drops, i + 1), F.lit(-1)) != p + 1)
    starts = F.filter(drops, lambda p, i: F.coalesce(F.get(drops, i - 1), F.lit(-2)) != p - 1)
    before = F.concat(F.array(F.lit(0)), F.transform(ends, lambda e: e + 1))
    runs = F.zip_with(before, F.concat(starts, F.array(n_lines)), lambda a, z: F.struct(a.alias("start"), (z - a).alias("n")))
    return F.filter(runs, lambda r: r["n"] > 0)


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, mark, drops``: the sorted positions of lines that go, for each document that loses any.

    Keys of at least ``min_chars`` code points that at least ``min_docs`` documents hold lose all their lines
    except those in the largest ``doc_id`` holding them.  Rows that repeat an id count as one document; ``mark``
    tells their texts apart.  Rows without ``doc_id`` or text neither count nor lose lines.  An empty table gives
    an empty result.
    """
    lines = stored(line_hashes(docs, min_chars), "lines")
    held = lines.where("first").groupBy("hash").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper"))
    held = stored(held.where(F.col("n_docs") >= min_docs).select("hash", "keeper"), "held")  # plain sides: Spark splits hot hashes
    gone = lines.join(held, "hash").where("doc_id <> keeper")
    # One document has no more positions than lines.
    return gone.groupBy("doc_id", "mark").agg(F.array_sort(F.collect_set("pos")).alias("drops"))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``docs`` with ``n_lines``, ``n_dropped``, ``keep`` (array of ``start, n`` runs of kept lines, counted from 0) and
    ``kept_text``, the kept lines joined by line ends.

    Null and empty texts are one empty line, which stays (``kept_text`` is empty).  Other columns pass through;
    columns named like the results are replaced.
    """
    results = ["n_lines", "n_dropped", "keep", "kept_text"]
    base = docs.drop(*results)
    found = bitmaps.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__mark"), F.col("drops").alias("__drops"))
    joined = base.join(found, (F.col("doc_id").cast("long") == F.col("__id")) & (_text_mark(F.col("text")) == F.col("__mark")), "left")

    def cut(lines):
        """Lines are bound to a variable here, so that the text is split once."""
        n = F.size(lines)
        keep = F.when(F.col("__drops").isNull(), F.array(F.struct(F.lit(0).alias("start"), n.alias("n")))).otherwise(_runs(F.col("__drops"), n))

        def pieces(runs):
            return F.array_join(F.transform(runs, lambda r: F.array_join(F.slice(lines, r["start"] + 1, r["n"]), "\n")), "\n")

        whole = F.coalesce(F.col("text"), F.lit(""))
        kept = F.when(F.col("__drops").isNull(), whole).otherwise(F.get(F.transform(F.array(keep), pieces), 0))
        return F.struct(n.cast("long").alias("n_lines"), keep.alias("keep"), kept.alias("kept_text"))

    made = joined.withColumn("__made", F.explode(F.transform(F.array(split_lines(F.col("text"))), cut)))
    n_dropped = F.when(F.col("__drops").isNull(), 0).otherwise(F.size("__drops")).cast("long").alias("n_dropped")
    made_columns = [F.col("__made")[c].alias(c) for c in ("n_lines", "keep", "kept_text")]
    return made.select(*[base[c] for c in base.columns], made_columns[0], n_dropped, *made_columns[1:])
