"""Merkle manifest of a table: one tree a group, a tree over the groups' roots, and a witness for every row.

Nodes are appended to a tree in order.  An open subtree holds a partial witness: the digests of its siblings so far.
Every later sibling that completes is added to it, and the eighth one closes their run and appends its digest one
level higher.  A row's witness is that of its own node, of the subtree it is in, and so on up to the root.

Appends are distributed by aligned blocks of 8^4 nodes, each streamed through one task.  A block's root is a node
four levels higher, so block roots are appended in the same way, until a group has one node, the subroot; subroots are
appended to the tree of the whole table.  Back down, a block takes its root's witness and ends the witnesses of its
nodes with it.  Rounds grow with the logarithm to base 4,096 of the rows, and texts are read once, for their digests.

Digests are lower-case hex SHA-256; a node's is that of its children's digests, concatenated as text.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpus_audit.llm.common import stored

ARITY = 8
LEVELS = 4  # of a block of 4,096 nodes
DIGITS = 64
_PATH = "array<struct<at:int,siblings:string>>"


def record_hash(*columns) -> Column:
    """SHA-256 of the values, each as its UTF-8 length, ``:`` and itself, or ``-`` for null."""

    def field(c):
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))

    return F.sha2(F.concat(*[field(F.col(c) if isinstance(c, str) else c) for c in columns]), 256)


# Streaming append


class Node:
    """A subtree: its digest, the digests of its siblings that are there so far, and how many of these are to its left."""

    __slots__ = ("digest", "at", "siblings", "parent")

    def __init__(self, digest: str):
        self.digest, self.at, self.siblings, self.parent = digest, 0, [], None


class Tree:
    """Appends nodes to a tree of a known height whose last runs may be short."""

    def __init__(self, height: int):
        self.height = height
        self.open: list[list[Node]] = [[] for _ in range(height + 1)]  # the open run of each level

    def append(self, digest: str, level: int = 0) -> Node:
        node, run = Node(digest), self.open[level]
        node.at = len(run)
        for earlier in run:
            node.siblings.append(earlier.digest)
            earlier.siblings.append(digest)
        run.append(node)
        if len(run) == ARITY and level < self.height:
            self._close(level)
        return node

    def _close(self, level: int) -> None:
        run, self.open[level] = self.open[level], []
        parent = self.append(sha256("".join(n.digest for n in run).encode()).hexdigest(), level + 1)
        for n in run:
            n.parent = parent

    def finish(self) -> str:
        """Close the short runs; the digest of the root."""
        for level in range(self.height):
            if self.open[level]:
                self._close(level)
        return self.open[self.height][0].digest


def path_of(node: Node) -> list[dict]:
    """The witness of a node in a finished tree, without its root: sibling digests by level, ``at`` of them to the left."""
    steps = []
    while node.parent is not None:
        steps.append({"at": node.at, "siblings": "".join(node.siblings)})
        node = node.parent
    return steps


def height_of(nodes: int) -> int:
    """Levels above this many nodes, until one remains; a lone node has none."""
    height = 0
    while nodes > 1:
        nodes, height = -(-nodes // ARITY), height + 1
    return height


def _grown(digests: list[str], total: int, levels: int) -> tuple[str, list[Node]]:
    """The tree of one block of a group of ``total`` nodes."""
    tree = Tree(min(height_of(total), levels))
    nodes = [tree.append(d) for d in digests]
    return tree.finish(), nodes


# Distributed rounds.  A round's nodes: grp, rank (from 0 in the group), total (of the group), digest, row


def _each_block(batches) -> Iterator:
    """A table for each block, of rows that come sorted by group and block."""
    import pyarrow as pa

    held, key = [], None
    for batch in batches:
        rows, start = pa.Table.from_batches([batch]), 0
        for i, found in enumerate(zip(batch["grp"].to_pylist(), batch["block"].to_pylist())):
            if found != key:
                held.append(rows.slice(start, i - start))
                if sum(map(len, held)):
                    yield pa.concat_tables(held)
                held, key, start = [], found, i
        held.append(rows.slice(start))
    if sum(map(len, held)):
        yield pa.concat_tables(held)


def _by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("grp", "block").sortWithinPartitions("grp", "block", "rank")


def _block(levels: int) -> Column:
    return F.expr(f"rank div {ARITY**levels}").alias("block")


def _roots(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes of the next round: the root of each block."""

    def grow(batches):
        import pyarrow as pa

        for rows in _each_block(batches):
            total = rows["total"][0].as_py()
            root, _ = _grown(rows["digest"].to_pylist(), total, levels)
            made = [rows["grp"].slice(0, 1).combine_chunks(), pa.array([rows["block"][0].as_py()]), pa.array([-(-total // ARITY**levels)]), pa.array([root])]
            yield pa.RecordBatch.from_arrays([m.chunk(0) if isinstance(m, pa.ChunkedArray) else m for m in made], ["grp", "rank", "total", "digest"])

    group = nodes.schema["grp"].dataType.simpleString()
    return _by_block(nodes.select("grp", _block(levels), "rank", "total", "digest")).mapInArrow(grow, f"grp {group}, rank long, total long, digest string")


def _witnessed(nodes: DataFrame, upper: DataFrame, levels: int) -> DataFrame:
    """``grp, rank, digest, row, path, above``: each node's witness, ended by that of its block's root.

    ``upper``: ``grp, rank`` of the block's root, its ``path`` and ``above`` (what rows are to carry)."""
    above, row = (d.schema[c].dataType.simpleString() for d, c in ((upper, "above"), (nodes, "row")))
    below = nodes.select("grp", _block(levels), "rank", "total", "digest", "row", F.lit(None).cast(_PATH).alias("path"), F.lit(None).cast(above).alias("above"))
    heads = upper.select(
        "grp", F.col("rank").alias("block"), F.lit(-1).cast("long").alias("rank"), F.lit(0).cast("long").alias("total"), F.lit(None).cast("string").alias("digest"),
        F.lit(None).cast(row).alias("row"), "path", "above",
    )
    out = f"grp {nodes.schema['grp'].dataType.simpleString()}, rank long, digest string, row {row}, path {_PATH}, above {above}"

    def extend(batches):
        import pyarrow as pa

        for rows in _each_block(batches):
            head, rows = rows.slice(0, 1), rows.slice(1)  # a block's head has rank -1
            _, nodes = _grown(rows["digest"].to_pylist(), rows["total"][0].as_py(), levels)
            end = head["path"][0].as_py()
            paths = pa.array([path_of(n) + end for n in nodes], rows.schema.field("path").type)
            for name, values in (("path", paths), ("above", pa.array(head["above"].to_pylist() * len(rows), head.schema.field("above").type))):
                rows = rows.set_column(rows.schema.get_field_index(name), rows.schema.field(name), values)
            yield from rows.select(["grp", "rank", "digest", "row", "path", "above"]).to_batches(max_chunksize=1024)

    return _by_block(below.unionByName(heads)).mapInArrow(extend, out)


def _ranked(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (with ``grp``) and their ``rank`` in the group by ``order``, and the ``total`` of the group.

    Rows are sorted over ranges, so a large group is spread; each range's rows of a group are counted once."""
    placed = stored(rows.repartitionByRange("grp", *order).sortWithinPartitions("grp", *order).withColumn("at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("part", F.shiftright("at", 33))
    parts = placed.groupBy("grp", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")
    before = F.coalesce(F.sum("n").over(group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(F.col("grp").alias("g"), F.col("part").alias("p"), (before - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    joined = placed.join(parts, placed["grp"].eqNullSafe(parts["g"]) & (F.col("part") == F.col("p")))
    return joined.select(*rows.columns, (F.col("at") + F.col("shift")).alias("rank"), "total")


def _rounds(nodes: DataFrame, name: str, levels: int) -> list[DataFrame]:
    """``nodes``, then block roots, until every group has one node."""
    rounds = [nodes]
    largest = nodes.agg(F.max("total")).first()[0] or 1
    while True:
        rounds.append(stored(_roots(rounds[-1], levels), f"{name}-{len(rounds)}").withColumn("row", F.lit(0)))
        largest = -(-largest // ARITY**levels)
        if largest == 1:
            return rounds


def _down(rounds: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """The witnesses of the first round's nodes, from those of the last round's."""
    for nodes in reversed(rounds[:-1]):
        top = _witnessed(nodes, top, levels)
    return top


def with_witnesses(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Leaves (``grp``, ``sort``, ``digest`` and any ``row``) to ``grp, digest, row, subroot, root, witness``.

    Per group, leaves ascend by ``sort`` and ``digest``; while several nodes remain, every 8 consecutive ones (the
    last run may be shorter, even one) become their hash.  The nodes that remain, a lone leaf among them, are ordered
    by group (null first, by UTF-8 bytes) and become the root in the same way.  ``witness`` lists, level by level
    up to the root, the siblings of the leaf and its ancestors, left to right, ``at`` of them before the node.
    ``levels`` are those of one block, whose ``8 ** levels`` nodes a task holds at once; results don't depend on it.
    """
    base = stored(_ranked(leaves, ["sort", "digest"]), "leaves")
    groups = _rounds(base.select("grp", "rank", "total", "digest", "row"), "groups", levels)
    lang = groups[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("sort"), "digest", F.col("grp").alias("row"))
    tops = _rounds(stored(_ranked(lang, ["sort", "digest"]).drop("sort"), "tops"), "tops", levels)
    none = F.array().cast(_PATH)
    root = tops[-1].select("grp", "rank", none.alias("path"), F.struct(F.col("digest").alias("root")).alias("above"))
    ends = _down(tops, root, levels).select(
        F.col("row").alias("grp"), F.lit(0).cast("long").alias("rank"), "path", F.struct(F.col("digest").alias("subroot"), F.col("above.root").alias("root")).alias("above")
    )
    return _down(groups, stored(ends, "subroots"), levels).select("grp", "digest", "row", "above.subroot", "above.root", F.col("path").alias("witness"))


def manifest(docs: DataFrame, columns=("doc_id", "source", "lang", "n_chars", "text"), group: str = "lang", order: str = "doc_id", levels: int = LEVELS, **carried) -> DataFrame:
    """``order, group, leaf, subroot, root, witness`` of every row, and the ``carried`` columns (name to expression).

    A leaf is the ``record_hash`` of ``columns``; see ``with_witnesses`` for the tree.  Null is a group of its own,
    rows without ``order`` come first, rows that repeat it follow each other by their leaf, and whole copies have
    equal leaves at different places.  Other columns are ignored; an empty table gives an empty result.
    """
    extra = F.struct(F.col(order).alias("o"), *[c.alias(f"c_{n}") for n, c in carried.items()])
    leaves = docs.select(F.col(group).cast("string").alias("grp"), F.col(order).alias("sort"), record_hash(*columns).alias("digest"), extra.alias("row"))
    made = with_witnesses(leaves, levels)
    return made.select(
        F.col("row.o").alias(order), F.col("grp").alias(group), F.col("digest").alias("leaf"), "subroot", "root", "witness", *[F.col(f"row.c_{n}").alias(n) for n in carried]
    )


def folded(leaf, witness) -> Column:
    """The root that a leaf and a witness give."""

    def step(digest, s):
        left = F.substr(s["siblings"], F.lit(1), s["at"] * DIGITS)
        right = F.substr(s["siblings"], s["at"] * DIGITS + 1)
        return F.sha2(F.concat(left, digest, right), 256)

    return F.aggregate(witness, leaf, step)


def witness_hash(witness) -> Column:
    """SHA-256 of all sibling digests of a witness, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(witness, lambda s: s["siblings"]), ""), 256)
