"""Document fingerprints that are homomorphic multiset hashes of paragraphs, by SQL functions alone.

Every paragraph (line) has a vector of 69 longs, and a fingerprint is their sum, entry by entry:

* 8 entries modulo 2^32, hashed from the paragraph: these tell multisets of paragraphs apart;
* 60 entries that each hold two counters modulo 2^30: of 120 hash bits of a sentence, how often each is set in
  the paragraph's sentences;
* the number of sentences, modulo 2^30.

A sum does not depend on the order, and paragraphs are inserted or deleted by adding or subtracting their vector,
without the rest of the text.  A counter and the number of sentences give a sum of +1 and -1; the cosine of
two such vectors of 120 sums estimates that of the multisets of sentences, and is the likeness.  No text that Spark can
hold has as many sentences as a counter counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_audit.llm.common import stored

WIDE = 8  # entries modulo 2^32
SIGNS = 120  # counted hash bits, 60 of each of two hashes
COUNTED = SIGNS // 2  # entries of two counters
LENGTH = WIDE + COUNTED + 1
_WIDE_MASK = (1 << 32) - 1
_COUNTER = (1 << 30) - 1
_PAIR = 1 + (1 << 32)  # two counters a long, 32 bits apart; the bits above each catch its carry
_COUNTER_MASK = _PAIR * _COUNTER
_HALF = SIGNS // 4  # of the bits of one hash
_HALF_MASK = (1 << _HALF) - 1
_NO_ID = -(2**63)  # stands for a missing id


def _paragraphs(text):
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda p: F.length(p) > 0)


def _sentences(text):
    """Pieces of lines that end behind a blank after ``.``, ``!`` or ``?``; the pieces of all lines in one array."""
    for mark in ".!?":
        text = F.replace(text, F.lit(mark + " "), F.lit(mark + "\n"))
    return _paragraphs(text)


def _zeros(n: int):
    return F.array_repeat(F.lit(0).cast("long"), n)


def _added(one, two, mask: int):
    return F.zip_with(one, two, lambda a, b: (a + b).bitwiseAND(F.lit(mask)))


def _wide_vector(paragraph):
    """Two entries of 32 bits from each of four hashes."""

    def halves(k):
        h = F.xxhash64(paragraph, F.lit(k))
        return [h.bitwiseAND(F.lit(_WIDE_MASK)), F.shiftrightunsigned(h, 32)]

    return F.array(*[x for k in range(WIDE // 2) for x in halves(k)])


def _sign_counts(sentences, seed: int):
    """How often each of 60 hash bits is set: bits k and k+30 of the hash count in entry k."""
    shifts = F.sequence(F.lit(0), F.lit(_HALF - 1))

    def count(sums, h):
        bits = lambda k: F.call_function("shiftrightunsigned", h, k).bitwiseAND(F.lit(_PAIR))
        return F.zip_with(sums, shifts, lambda a, k: a + bits(k))

    def spread(x):
        h = F.xxhash64(x, F.lit(seed))
        low, high = h.bitwiseAND(F.lit(_HALF_MASK)), F.shiftrightunsigned(h, _HALF).bitwiseAND(F.lit(_HALF_MASK))
        return low.bitwiseOR(F.shiftleft(high, 32))

    return F.aggregate(F.transform(sentences, spread), _zeros(_HALF), count)


def fingerprint_vector(text) -> F.Column:
    """The 69 longs of a text; null and empty texts, which have no paragraphs, have zeros."""
    wide = F.aggregate(_paragraphs(text), _zeros(WIDE), lambda s, p: _added(s, _wide_vector(p), _WIDE_MASK))

    def counted(sentences):
        return F.concat(_sign_counts(sentences, 101), _sign_counts(sentences, 102), F.array(F.size(sentences).cast("long")))

    # Sentences are bound to a variable, so that the text is split once.
    return F.concat(wide, F.flatten(F.transform(F.array(_sentences(F.coalesce(text, F.lit("")))), counted)))


def combine(one, two, sign: int = 1) -> F.Column:
    """The vector of all paragraphs of two texts (``sign`` 1), or of the first without the second's (-1)."""

    def entries(a, n, mask, ones):
        other = F.slice(two, a, n)
        if sign < 0:
            # per counter: its modulus less its value, so that no borrow passes to the next
            other = F.transform(other, lambda x: (F.lit(mask) - x + F.lit(ones)).bitwiseAND(F.lit(mask)))
        return _added(F.slice(one, a, n), other, mask)

    return F.concat(entries(1, WIDE, _WIDE_MASK, 1), entries(WIDE + 1, COUNTED, _COUNTER_MASK, _PAIR), entries(LENGTH, 1, _COUNTER, 1))


def _sums(vector):
    """The 120 sums of +1 and -1."""
    n = F.element_at(vector, LENGTH)
    pairs = F.slice(vector, WIDE + 1, COUNTED)
    low = F.transform(pairs, lambda x: (x.bitwiseAND(F.lit(_COUNTER)) * 2 - n).cast("double"))
    return F.concat(low, F.transform(pairs, lambda x: (F.shiftrightunsigned(x, 32) * 2 - n).cast("double")))


def _dot(one, two):
    return F.aggregate(F.zip_with(one, two, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)


def likeness(one, two) -> F.Column:
    """0 to 1: the cosine of two fingerprints' sums, not below 0; 1 for equal ones, 0 where one text has no paragraphs."""

    def cosine(sums):
        a, b = sums["a"], sums["b"]
        size = F.sqrt(_dot(a, a) * _dot(b, b))
        return F.when(size > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), _dot(a, b) / size))).otherwise(0.0)

    sums = F.array(F.struct(_sums(one).alias("a"), _sums(two).alias("b")))
    return F.when(one == two, 1.0).otherwise(F.get(F.transform(sums, cosine), 0))


def as_string(vector) -> F.Column:
    """Hex: 8 digits for each wide entry, 16 for two counters, 8 for the number of sentences."""

    def digits(a, n, width):
        return F.array_join(F.transform(F.slice(vector, a, n), lambda x: F.lpad(F.hex(x), width, "0")), "")

    return F.lower(F.concat(digits(1, WIDE, 8), digits(WIDE + 1, COUNTED, 16), digits(LENGTH, 1, 8)))


# A document and the one that follows it


def _followers(keys: DataFrame) -> DataFrame:
    """``id, d, n, next_id, next_d`` of distinct ``id, d, n`` in descending order; the first follows the last.

    Ranges of ids are ordered each on its own; a row for each range says where the next one starts."""
    here = stored(keys.repartitionByRange(F.desc("id"), F.desc("d")).withColumn("part", F.spark_partition_id()), "order")
    order = Window.partitionBy("part").orderBy(F.desc("id"), F.desc("d"))
    heads = here.groupBy("part").agg(F.max(F.struct("id", "d")).alias("head"))
    ring = Window.orderBy("part")
    first = F.first("head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("part", F.coalesce(F.lead("head").over(ring), first).alias("following"))
    following = F.lead(F.struct("id", "d")).over(order)
    placed = here.withColumn("own", following).join(heads, "part").withColumn("next", F.coalesce("own", "following"))
    return placed.select("id", "d", "n", F.col("next.id").alias("next_id"), F.col("next.d").alias("next_d"))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Per row of ``doc_id, text``: ``doc_id, n_chars, edited, vector, edited_vector, next_vector``.

    ``edited`` is the text with its last third of code points replaced by as many, or all, of the first ones of
    the next document in descending ``doc_id`` order; the last is followed by the first.  A null text counts
    as empty.  Rows without ``doc_id`` come after all others.  Rows that repeat an id follow each other by
    their text's digest; rows that repeat both count as one document and all have its result.  A single
    document follows itself.  Other columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("id"),
        text.alias("text"),
        F.md5(F.concat(F.when(F.col("doc_id").isNull(), F.lit("-")).otherwise("+"), text).cast("binary")).alias("d"),
    )
    ring = _followers(rows.select("id", "d", F.length("text").cast("long").alias("n")).distinct())
    third = F.floor(F.col("n") / 3).cast("int")
    asked = ring.select(F.col("next_id").alias("id"), F.col("next_d").alias("d"), F.col("id").alias("for_id"), F.col("d").alias("for_d"), third.alias("k"))
    given = rows.join(asked, ["id", "d"]).select(
        F.col("for_id").alias("id"), F.col("for_d").alias("d"), F.expr("substring(text, 1, k)").alias("tail"), fingerprint_vector(F.col("text")).alias("next_vector")
    ).dropDuplicates(["id", "d"])
    pairs = rows.join(given, ["id", "d"]).withColumn("n_chars", F.length("text").cast("long"))
    kept = F.expr("substring(text, 1, cast(n_chars - floor(n_chars / 3) AS int))")
    doc_id = F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id")
    pairs = pairs.select(doc_id, "n_chars", "text", F.concat(kept, F.col("tail")).alias("edited"), "next_vector")
    vectors = [fingerprint_vector(F.col("text")).alias("vector"), fingerprint_vector(F.col("edited")).alias("edited_vector")]
    return pairs.select("doc_id", "n_chars", "edited", *vectors, "next_vector")
