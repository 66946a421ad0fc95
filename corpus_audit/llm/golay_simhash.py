"""Near-duplicates by SimHash, found with keys from the binary Golay code.

A fingerprint of 64 bits is cut into segments of 23, 23 and 18 bits (the last filled up with zeros).  The Golay
code is perfect: every word of 23 bits has one codeword within 3 bits, so decoding names one of 4,096 indices.
The words within one bit of a segment decode to one index or to six, its nearby indices; if two segments
differ in at most one bit, the index of one is among the nearby indices of the other.

Of three bits in all, the first two segments hold at most one each, or one of them holds two or three and the
other two segments at most one together.  So two linked fingerprints agree in one of these keys:

* first and second segment, an index of one side in the nearby indices of the other for both;
* first and third, or second and third: the same index in one and a nearby index in the other.

Every fingerprint offers three keys and asks for about fifty; an equi join brings candidates together, and the
bit distance decides.  Keys that too many fingerprints offer (a large group of near copies) are left out of
that join; the fingerprints behind them are linked through midpoints instead, see ``_linked_by_midpoints``.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import stored, text_batches, worker_cache
from corpus_audit.llm.components import components

SHINGLE = 3
BITS = 3
HOT_KEY = 4096  # fingerprints that offer one key; beyond it they are linked through midpoints
SEGMENTS = ((0, 23), (23, 23), (46, 18))  # first bit, bits
GENERATOR = 0xC75  # of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1


# Fingerprints


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash over hashed word shingles, repeats included: a bit is 1 if it is set in over half the hashes."""
    from xxhash import xxh64_intdigest as digest

    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    if not words:
        return 0
    ones, n = np.zeros(64, np.int64), max(1, len(words) - shingle + 1)
    for start in range(0, n, 1 << 16):
        part = words[start : min(start + (1 << 16), n) + shingle - 1]
        spans = zip(*(part[k:] for k in range(shingle))) if len(part) >= shingle else [part]
        hashes = np.array([digest(b" ".join(s), 42) for s in spans], np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` without ``text``, with ``fp`` (the 64 bits as a signed long); a null or empty text has 0."""
    schema = ", ".join(f"`{c}` {kind}" for c, kind in docs.drop("text", "fp").dtypes)

    def each(batches):
        worker_cache("golay_simhash")
        for batch in batches:
            batch["fp"] = [fingerprint(t, shingle) for t in batch.pop("text")]
            yield batch

    return docs.drop("fp").mapInPandas(each, f"{schema}, fp long")


# Golay keys


def _syndromes(words: np.ndarray) -> np.ndarray:
    """The remainder of each word, a polynomial over GF(2) of degree below 23, by the generator."""
    words = words.copy()
    for bit in range(22, 10, -1):
        words ^= ((words >> np.int64(bit)) & 1) * np.int64(GENERATOR << (bit - 11))
    return words


class GolayCode:
    """Decoding by a table of the error pattern of each of the 2,048 remainders."""

    def __init__(self):
        one = 1 << np.arange(23, dtype=np.int64)
        two = (one[:, None] | one[None, :])[np.triu_indices(23, 1)]
        three = np.unique((two[:, None] | one[None, :]).ravel())
        errors = np.concatenate(([0], one, two, three[np.bitwise_count(three) == 3]))
        self.error = np.zeros(2048, np.int64)
        self.error[_syndromes(errors)] = errors
        self.remainder = _syndromes(np.arange(1 << 12, dtype=np.int64)), _syndromes(np.arange(1 << 11, dtype=np.int64) << 12)

    def index(self, words: np.ndarray) -> np.ndarray:
        """The index, 0 to 4095, of the codeword within 3 bits of each word."""
        low, high = self.remainder
        return (words ^ self.error[low[words & 4095] ^ high[words >> 12]]) >> 11

    def nearby(self, words: np.ndarray, bits: int) -> list[np.ndarray]:
        """For each word, the indices of all words that differ from it in at most one of the lowest ``bits``."""
        flips = np.concatenate(([0], 1 << np.arange(bits, dtype=np.int64)))
        return [np.unique(row) for row in self.index(words[:, None] ^ flips[None, :])]


def golay() -> GolayCode:
    known = worker_cache("golay_simhash")
    if "code" not in known:
        known["code"] = GolayCode()
    return known["code"]


def _segments(fps: np.ndarray) -> list[np.ndarray]:
    bits = fps.astype(np.int64).view(np.uint64)
    return [((bits >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]


def _key(table: int, first, second):
    return (table << 24) | (first << 12) | second


def offered_keys(fps: np.ndarray) -> np.ndarray:
    """One key for each pair of segments: an array of three columns."""
    a, b, c = (golay().index(s) for s in _segments(fps))
    return np.stack([_key(0, a, b), _key(1, a, c), _key(2, b, c)], axis=1)


def asked_keys(fps: np.ndarray) -> list[np.ndarray]:
    """All keys under which a fingerprint within three bits offers itself."""
    own = [golay().index(s) for s in _segments(fps)]
    near = [golay().nearby(s, n) for s, (_, n) in zip(_segments(fps), SEGMENTS)]
    out = []
    for i in range(len(fps)):
        (a, b, c), (na, nb, nc) = (x[i] for x in own), (x[i] for x in near)
        keys = [_key(0, na[:, None], nb[None, :]).ravel()]
        for table, one, two, n1, n2 in ((1, a, c, na, nc), (2, b, c, nb, nc)):
            keys += [_key(table, n1, two), _key(table, one, n2[n2 != two])]
        out.append(np.concatenate(keys))
    return out


# Links


def _offers(nodes: DataFrame) -> DataFrame:
    def each(batches):
        for b in batches:
            keys = offered_keys(b["fp"].to_numpy())
            yield b.loc[b.index.repeat(3)].assign(key=keys.ravel().astype("int32"))

    return nodes.mapInPandas(each, "node long, fp long, key int")


def _asks(nodes: DataFrame) -> DataFrame:
    def each(batches):
        for b in batches:
            for start in range(0, len(b), 2000):
                part = b.iloc[start : start + 2000]
                keys = asked_keys(part["fp"].to_numpy())
                yield part.loc[part.index.repeat([len(k) for k in keys])].assign(key=np.concatenate(keys).astype("int32"))

    return nodes.mapInPandas(each, "node long, fp long, key int")


def _around(nodes: DataFrame, bits: int) -> DataFrame:
    """``node, point`` for all points of 64 bits that differ from the fingerprint in at most ``bits`` (1 or 2)."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    masks = np.concatenate(([np.uint64(0)], one, (one[:, None] | one[None, :])[np.triu_indices(64, 1)] if bits == 2 else []))
    masks = masks.astype(np.uint64)

    def each(batches):
        for b in batches:
            for start in range(0, len(b), 100):
                part = b.iloc[start : start + 100]
                points = part["fp"].to_numpy().astype(np.int64).view(np.uint64)[:, None] ^ masks[None, :]
                yield part[["node"]].loc[part.index.repeat(len(masks))].assign(point=points.ravel().view(np.int64))

    return nodes.mapInPandas(each, "node long, point long")


def _linked_by_midpoints(nodes: DataFrame) -> DataFrame:
    """All links within three bits among ``nodes``, as paths of such links, without forming pairs.

    Fingerprints within one bit of a common point are within two bits of each other, and one within two bits of
    it is within three of each of them.  So all of these are linked to the smallest of the first kind.  Each
    pair within three bits has such a point.  The rows grow with the fingerprints, not with their pairs.
    """
    hubs = _around(nodes, 1).groupBy("point").agg(F.min("node").alias("b"))
    return _around(nodes, 2).join(hubs, "point").where("node <> b").select(F.col("node").alias("a"), "b")


def links(nodes: DataFrame, hot_key: int = HOT_KEY) -> DataFrame:
    """``(a, b)`` links that connect exactly the nodes which fingerprints within three bits connect.

    ``nodes``: ``node long, fp long`` with distinct fingerprints.
    """
    offers, asks = _offers(nodes), _asks(nodes)
    hot = offers.groupBy("key").count().where(F.col("count") > hot_key).select("key")
    near = F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= BITS
    other = offers.join(hot, "key", "left_anti").select("key", F.col("node").alias("node2"), F.col("fp").alias("fp2"))
    apart = asks.join(other, "key").where(near & (F.col("node") != F.col("node2")))
    behind = asks.join(hot, "key", "left_semi").select("node", "fp").union(offers.join(hot, "key", "left_semi").select("node", "fp"))
    return apart.select(F.col("node").alias("a"), F.col("node2").alias("b")).union(_linked_by_midpoints(behind.distinct()))


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, hot_key: int = HOT_KEY, carried: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, fingerprint, component_id`` and the ``carried`` columns for every row of ``docs`` (``doc_id, text``; other
    columns are ignored).

    Texts that are null, empty or blank have fingerprint zero and are linked like any other.  Equal texts, and
    rows that repeat, share a fingerprint and so a component.  ``component_id`` is the smallest ``doc_id``
    that can be reached over links of at most three bits.  A row without ``doc_id`` keeps its fingerprint and
    gets the component of the rows with the same one (null if there is none), but links nothing itself.  An
    empty table gives an empty result.
    """
    text_batches(docs.sparkSession)
    marked = stored(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carried), shingle), "simhash")
    nodes = marked.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")).select("node", "fp")
    found = components(links(nodes, hot_key))
    groups = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(groups, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carried
    )
