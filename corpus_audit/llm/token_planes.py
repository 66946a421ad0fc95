"""Token ids in files of compressed planes.

A shard holds the ids of a run of documents in ascending ``doc_id`` order, each with an end id:

* blocks of a fixed number of ids (the last may be shorter), as unsigned 32-bit little-endian integers, transposed
  into 4 byte planes or 32 bit planes; each plane is compressed on its own with zstandard.  High planes of small
  ids are runs of zeros and cost a few bytes;
* the index, compressed: for each block its number of ids and the place and length of each plane, and for
  each document its id and number of ids;
* 16 bytes with place and length of the index, and the 8 bytes of the mark.

Blocks don't end with documents, so one id can be found by its position alone: divide by the block size.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpus_audit.llm.common import open_files, put_file, run_folder, stored, worker_cache

MARK = b"IDPLANES"
BLOCK_IDS = 1 << 16
LEVEL = 3
LONG_PIECE = 64
ROWS_AT_ONCE = 2048  # encoded together
CACHED_WORDS = 400_000  # encoded words that a worker keeps, up to twice


# Encoding

_LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"  # letters in all versions of Unicode
_MARKS = r"!-&(-/:-@\[-`{-~"  # ASCII punctuation without the apostrophe, which may be in a word


def _written() -> np.ndarray:
    """The character that a byte-level tokenizer writes for each byte; here a space separates words, and 0 is a space in one."""
    as_is = [*range(33, 127), *range(161, 173), *range(174, 256)]
    chars = np.zeros(256, "<u4")
    chars[as_is] = as_is
    chars[chars == 0] = np.arange(256, 256 + 256 - len(as_is))
    chars[0], chars[32] = chars[32], 32
    return chars


_WRITTEN = _written()
_IS_MARK = np.array([bool(re.match(f"[{_MARKS}]", chr(b))) for b in range(256)])


class WordwiseEncoder:
    """Texts to ids, equal to encoding each whole text with the ``tokenizers`` library.

    A byte-level tokenizer that splits by its usual pattern never joins what stands before a single space and
    after it, so texts are cut before single spaces.  A single line end is a word of its own, so texts are cut there too; a
    line end stays with the piece behind it.  The pieces of a call are numbered, behind those known from earlier calls, by
    a dictionary; new ones are encoded, and the ids of all are taken by number.  Letters, with or without marks behind them,
    are split without the pattern, and the model gets the words.  Texts with two white space characters in a row or with a
    special token, and all texts under other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        made = json.loads(self.tokenizer.to_str())
        split = made.get("pre_tokenizer") or {}
        self.by_piece = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") and not made.get("normalizer")
        special = [t["content"] for t in made.get("added_tokens", [])]
        self.by_piece = self.by_piece and not any(re.search(r"\s", t) for t in special)
        # Pieces that are split without the pattern; none if a special token may be in one.
        self.plain = rf"^\n?[{_LETTERS}]+[{_MARKS}]*$"
        if any(re.fullmatch(f"[{_LETTERS}]*[{_MARKS}]*", t) for t in special):
            self.plain = r"[^\s\S]"
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        # Pieces beside which a cut may not be one: empty ones, white space at an end or twice, special tokens.
        self.odd = re.compile("|".join([r"\A\Z", r"\A\s", r"\s\Z", r"\s\s", *map(re.escape, special)]))
        self.lengths = np.zeros(self.tokenizer.get_vocab_size(), np.int64)  # bytes of each token; a character each, as written
        if self.by_piece:
            for token, i in self.tokenizer.get_vocab().items():
                self.lengths[i] = len(token)
        self.cached = cached
        # Pieces known, a line end before some, with their ids (null for odd ones) and the last call that they came in.
        self.pieces, self.ids, self.last, self.calls = pa.array([], pa.large_string()), pa.array([], pa.large_binary()), np.zeros(0, np.int64), 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_pieces(self, pieces: list[str], lead: str) -> list[bytes]:
        """The ids of ``lead`` and each piece, encoded as one text and cut by the bytes that the tokens stand for."""
        if not pieces:
            return []
        text = lead + lead.join(pieces)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        written = np.frombuffer((text + lead).encode("utf-8", "surrogatepass"), np.uint8)
        ends = np.flatnonzero(written == ord(lead))[1:]  # no piece holds its lead
        cuts = (np.searchsorted(np.cumsum(self.lengths[ids]), ends) + 1) * 4
        data, starts = ids.tobytes(), [0, *cuts[:-1].tolist()]
        return [data[a:z] for a, z in zip(starts, cuts.tolist())]

    def _ids_of_plain(self, pieces: pa.Array) -> pa.Array:
        """The ids of plain pieces: their words are separated, written as the model has them, and encoded as one text."""
        if not len(pieces):
            return pa.array([], pa.large_binary())
        one = pa.ListArray.from_arrays([0, len(pieces)], pieces)
        text = "\0" + pc.binary_join(one, pa.scalar(" \0", pa.large_string()))[0].as_py()
        raw = np.frombuffer(text.replace("\0\n", "\n ").encode(), np.uint8)
        marks = _IS_MARK[raw]
        chars = np.insert(_WRITTEN[raw], np.flatnonzero(marks[1:] > marks[:-1]) + 1, ord(" "))
        ids = np.array(self.model.encode_batch_fast([chars.tobytes().decode("utf-32-le")], add_special_tokens=False)[0].ids, "<u4")
        sizes = pc.binary_length(pieces).to_numpy() + ~pc.starts_with(pieces, "\n").to_numpy(zero_copy_only=False)
        cuts = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum(sizes)) + 1
        places = np.concatenate([[0], cuts * 4]).astype("<i8")
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(places), pa.py_buffer(ids)])

    def _ids_of_new(self, pieces: pa.Array) -> pa.Array:
        """The ids of pieces in their order, null for odd ones."""
        plain = pc.match_substring_regex(pieces, self.plain)
        others = pieces.filter(pc.invert(plain)).to_numpy(zero_copy_only=False).tolist()
        found: dict[str, bytes] = {}
        for lead, mine in ((" ", [p for p in others if p[:1] != "\n"]), ("\n", [p for p in others if p[:1] == "\n"])):
            bodies = [p.removeprefix("\n") for p in mine]
            even = [(p, b) for p, b in zip(mine, bodies) if not self.odd.search(b)]
            found.update(zip([p for p, _ in even], self._ids_of_pieces([b for _, b in even], lead)))
        both = pa.concat_arrays([self._ids_of_plain(pieces.filter(plain)), pa.array([found.get(p) for p in others], pa.large_binary())])
        order = np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")  # where each of both stands in pieces
        places = np.empty(len(order), np.int64)
        places[order] = np.arange(len(order))
        return both.take(pa.array(places))

    def _forget(self) -> None:
        """Long pieces are known for one call alone; of too many, the last used stay."""
        keep = pc.binary_length(self.pieces).to_numpy() <= LONG_PIECE
        if len(keep) > 2 * self.cached:
            keep &= self.last >= np.partition(self.last, -self.cached)[-self.cached]
        if not keep.all():
            self.pieces, self.ids, self.last = self.pieces.filter(pa.array(keep)), self.ids.filter(pa.array(keep)), self.last[keep]

    def _know(self, pieces: pa.Array) -> pa.Array:
        """The number of each piece among those known, which then have the ids of all of these."""
        known = len(self.pieces)
        numbered = pa.concat_arrays([self.pieces, pieces]).dictionary_encode()
        self.pieces, numbers = numbered.dictionary, numbered.indices[known:]
        self.ids = pa.concat_arrays([self.ids, self._ids_of_new(self.pieces[known:])])
        self.calls += 1
        self.last = np.concatenate([self.last, np.zeros(len(self.pieces) - known, np.int64)])
        self.last[numbers.to_numpy()] = self.calls
        return numbers

    def encode(self, texts: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        if not self.by_piece or not texts:
            return self._ids(texts)
        self._forget()
        cut = pc.split_pattern(pc.replace_substring(pa.array(texts, pa.large_string()), "\n", " \n"), " ")
        rows, behind = cut.offsets.to_numpy(), np.ones(len(cut.values), bool)
        behind[rows[:-1]] = False  # the first of a text has no lead
        firsts = cut.values.take(pa.array(rows[:-1])).to_pylist()
        numbers = self._know(cut.values.filter(pa.array(behind)))
        found, rows = self.ids.take(numbers), rows - np.arange(len(rows))
        _, places, data = found.buffers()
        data, ends = memoryview(data or b""), np.frombuffer(places, "<i8")[rows].tolist()
        out = [ids + data[a:z] for ids, a, z in zip(self._ids(firsts), ends, ends[1:])]
        odd = np.flatnonzero(found.is_null().to_numpy(zero_copy_only=False))
        whole = {*(np.searchsorted(rows, odd, "right") - 1).tolist(), *(n for n, first in enumerate(firsts) if first and self.odd.search(first.lstrip()))}
        for n, ids in zip(whole, self._ids([texts[n] for n in whole])):
            out[n] = ids
        return out


# Format


def planes_of(ids: np.ndarray, bits: bool) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of a block."""
    table = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if bits:
        return [p.tobytes() for p in np.packbits(np.unpackbits(table, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [p.tobytes() for p in np.ascontiguousarray(table.T)]


def ids_of(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == 32:
        rows = np.array([np.unpackbits(np.frombuffer(p, np.uint8), bitorder="little")[:n] for p in planes])
        table = np.packbits(rows.T, axis=1, bitorder="little")
    else:
        table = np.array([np.frombuffer(p, np.uint8) for p in planes]).reshape(4, n).T
    return np.ascontiguousarray(table).view("<u4").ravel()


class PlaneWriter:
    """Writes documents one after another; holds one block and the index."""

    def __init__(self, stream, block_ids: int = BLOCK_IDS, bits: bool = False, level: int = LEVEL):
        import zstandard

        self.stream, self.block_ids, self.bits = stream, block_ids, bits
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.buffer = bytearray()
        self.at, self.blocks, self.doc_ids, self.sizes = 0, [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)
        self.buffer += ids
        whole = len(self.buffer) // (4 * self.block_ids) * 4 * self.block_ids
        for start in range(0, whole, 4 * self.block_ids):
            self._block(self.buffer[start : start + 4 * self.block_ids])
        del self.buffer[:whole]

    def _block(self, data: bytes) -> None:
        planes = []
        for plane in planes_of(np.frombuffer(data, "<u4"), self.bits):
            packed = self.pack(plane)
            self.stream.write(packed)
            planes.append((self.at, len(packed)))
            self.at += len(packed)
        self.blocks.append((len(data) // 4, planes))

    def close(self) -> int:
        """Ends the file; the number of ids in it."""
        if self.buffer:
            self._block(bytes(self.buffer))
        index = self.pack(json.dumps({"block_ids": self.block_ids, "blocks": self.blocks, "doc_ids": self.doc_ids, "sizes": self.sizes}).encode())
        self.stream.write(index)
        self.stream.write(struct.pack("<QQ", self.at, len(index)) + MARK)
        return sum(self.sizes)


def read_planes(source) -> Iterator[tuple[int | None, int, bytes]]:
    """``doc_id``, ids before it in the file, and its ids, from a seekable file; holds one block and one document."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    source.seek(source.size() - 24)
    at, length, mark = struct.unpack("<QQ8s", source.read(24))
    if mark != MARK:
        raise ValueError("not a file of id planes")
    source.seek(at)
    index = json.loads(unpack(source.read(length)))

    def blocks():
        for n, planes in index["blocks"]:
            source.seek(planes[0][0])
            data = source.read(sum(size for _, size in planes))
            cuts = [p - planes[0][0] for p, _ in planes]
            yield ids_of([unpack(data[c : c + size]) for c, (_, size) in zip(cuts, planes)], n).tobytes()

    ready, start, more = bytearray(), 0, blocks()
    for doc_id, size in zip(index["doc_ids"], index["sizes"]):
        while len(ready) < 4 * size:
            ready += next(more)
        yield doc_id, start, bytes(ready[: 4 * size])
        del ready[: 4 * size]
        start += size


# Spark


def write_ids(docs: DataFrame, tokenizer_file: str, end_id: int, folder: str | None = None, block_ids: int = BLOCK_IDS, bits: bool = False) -> DataFrame:
    """Encode ``doc_id, text`` and write the shards; returns ``shard, path, n_docs, n_ids``, a row for each file.

    Texts are dealt out by ranges of ``doc_id`` and sorted, so shards follow each other in ascending order.  A
    null or empty text has the end id alone.  Rows without ``doc_id`` come first; rows that repeat an id
    are all kept, by their text's order.  Other columns are ignored.  An empty table writes no file.
    """
    folder = folder or run_folder(docs.sparkSession, "ids")
    end = struct.pack("<I", end_id)

    def write(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        path, counts = f"{folder}/shard-{shard:06d}.planes", {}
        encoder = _encoder(tokenizer_file)
        batches = (b for b in batches if len(b))
        first = next(batches, None)
        if first is None:
            return

        def fill(stream) -> None:
            writer = PlaneWriter(stream, block_ids, bits)
            for batch in _chain(first, batches):
                for k in range(0, len(batch), ROWS_AT_ONCE):
                    part = batch.iloc[k : k + ROWS_AT_ONCE]
                    for doc_id, ids in zip(part["doc_id"], encoder.encode([t or "" for t in part["text"]])):
                        writer.add(None if pd.isna(doc_id) else int(doc_id), ids + end)
            counts.update(n_ids=writer.close(), n_docs=len(writer.sizes))

        put_file(path, fill)
        yield pd.DataFrame([{"shard": shard, "path": path, **counts}])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInPandas(write, "shard int, path string, n_ids long, n_docs long"), "shards")


def read_ids(shards: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document in the files of ``write_ids``: ``start`` counts the ids
    of all documents before it, ``ids`` are its little-endian unsigned 32-bit integers, end id included.

    A running sum over the table of files, a short row for each, gives where each file starts."""

    def read(batches: Iterable) -> Iterator:
        import pandas as pd

        for batch in batches:
            for path, before in zip(batch["path"], batch["before"]):
                files, name = open_files(path)
                with files.open_input_file(name) as source:
                    part, size = [], 0
                    for doc_id, start, ids in read_planes(source):
                        part.append((doc_id, int(before) + start, len(ids) // 4, ids))
                        size += len(ids)
                        if size > 8 << 20:
                            yield _frame(pd, part)
                            part, size = [], 0
                    if part:
                        yield _frame(pd, part)

    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("path", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0)).alias("before"))
    return placed.repartition(max(1, shards.count())).mapInPandas(read, "doc_id long, start long, n_tokens long, ids binary")


def _frame(pd, rows: list[tuple]):
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    return frame.astype({"doc_id": "Int64"})


def _chain(first, rest):
    yield first
    yield from rest


def _encoder(path: str) -> WordwiseEncoder:
    """One encoder for each worker process."""
    known = worker_cache("token_planes")
    if path not in known:
        known[path] = WordwiseEncoder(path)
    return known[path]
