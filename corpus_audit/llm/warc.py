"""WARC archives with segmented records: writing, reading, and putting segments together again.

A page becomes a record whose block is an HTTP response with chunked transfer framing.  A block beyond the
segment size is written as a first segment and ``continuation`` records, which may stand in later files.  When
read, segments are grouped by the record they continue, ordered by their number, checked against the total
length that the last one states, and only then decoded.
"""

from __future__ import annotations

import base64
import gzip
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_audit.llm.common import open_files, put_file, run_folder, stored

SEGMENT_BYTES = 16 << 10
CHUNK_BYTES = 4 << 10
FILE_BYTES = 32 << 20  # of compressed records
REVISIT_BYTES = 1000
DATE = "2001-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_HEX = re.compile(rb"[0-9a-fA-F]{1,15}")
_DIGITS = re.compile(r"[0-9]{1,18}")

# Framing


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    out = [b"%x\r\n%b\r\n" % (len(part), part) for part in (payload[k : k + size] for k in range(0, len(payload), size))]
    return b"".join([*out, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload in chunked transfer framing; extensions and trailers are skipped.  Broken framing raises."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        digits = body[at:end].split(b";")[0].strip(b" \t")
        if not _HEX.fullmatch(digits):
            raise ValueError("a chunk without a size")
        size, at = int(digits, 16), end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + size])
        at += size + 2


def http_block(payload: bytes | None) -> bytes:
    """An HTTP response with this payload, or its header alone."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
    return head if payload is None else head + chunked(payload)


def http_payload(block: bytes) -> bytes | None:
    """The decoded payload of an HTTP response; None where the framing is broken."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    lines = [line.partition(b":") for line in head.split(b"\r\n")[1:]]
    coding = {name.strip().lower(): value.strip().lower() for name, _, value in lines}
    try:
        return unchunked(body) if coding.get(b"transfer-encoding") == b"chunked" else body
    except ValueError:
        return None


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record, compressed as a member of its own."""
    head = "".join(f"{name}: {value}\r\n" for name, value in [*fields, ("Content-Length", str(len(block)))])
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", compresslevel=4, mtime=0)


def segments(fields: list[tuple[str, str]], origin: str, block: bytes, size: int = SEGMENT_BYTES) -> Iterator[bytes]:
    """The record of a block, or its first segment and its continuations."""
    if len(block) <= size:
        yield record([*fields, ("WARC-Record-ID", f"<{origin}>")], block)
        return
    starts = range(0, len(block), size)
    for number, at in enumerate(starts, 1):
        own = [("WARC-Segment-Number", str(number))]
        if number == 1:
            own = [*fields, ("WARC-Record-ID", f"<{origin}>"), *own]
        else:
            own += [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'{origin}/{number}').urn}>"), ("WARC-Segment-Origin-ID", f"<{origin}>"), ("WARC-Date", DATE)]
        if number == len(starts):
            own.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record(own, block[at : at + size])


def _number(value: str | None) -> int | None:
    return int(value) if value is not None and _DIGITS.fullmatch(value) else None


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Fields (names in lower case) and block of each record of a file; one record at a time.

    The block is None where it can't be told or is cut short.  Behind a record without a length the next line that begins
    with ``WARC/`` is taken for a record; nothing is read behind broken compression."""
    source = gzip.GzipFile(fileobj=stream)  # its own buffer: a further one would read ahead into a broken member
    fields: dict[str, str] | None = None
    try:
        version = source.readline()
        while version:
            if version.startswith(b"WARC/"):
                fields = {}
                while (line := source.readline()).strip():
                    name, _, value = line.decode("utf-8", "replace").partition(":")
                    fields[name.strip().lower()] = value.strip()
                length = _number(fields.get("content-length"))
                block = None if length is None else source.read(length)
                found, fields = fields, None
                yield found, block if block is not None and len(block) == length else None
            version = source.readline()
    except (EOFError, OSError, zlib.error):  # gzip.BadGzipFile is an OSError
        if fields is not None:
            yield fields, None


# Writing


def _with_revisits(pages: DataFrame, least: int) -> DataFrame:
    """``page_id, url, payload, sha1, refers_to``.  Of equal payloads of at least ``least`` bytes, the row with the
    largest id stays, others refer to it."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")
    )
    rows = rows.withColumn("sha1", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least).withColumn("same", F.sha2("payload", 256))
    groups = large.groupBy("same").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # Small payloads meet no group; groups are stored, so that Spark splits the rows of a hot one.
    meets = large.join(stored(groups, "groups"), "same", "left")
    refers_to = F.when(F.col("page_id").isNull() | (F.col("page_id") < F.col("last")), F.col("last")).alias("refers_to")
    small = rows.where(F.octet_length("payload") < least).withColumn("refers_to", F.lit(None).cast("long"))
    return meets.select("page_id", "url", "payload", "sha1", refers_to).unionByName(small)


def _line(value: str) -> str:
    return "".join(c for c in value if c >= " ")


def write_archives(pages: DataFrame, folder: str | None = None, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES, least: int = REVISIT_BYTES) -> DataFrame:
    """Write a record for each row of ``page_id, url, html``; returns ``path, bytes`` of the files.

    A null html is an empty payload; a null url gives a record without target.  Rows that repeat an id have a
    record each; those that share the largest id of equal payloads are all responses.  A row without id is a
    revisit where its payload has a row with one, else a response.  Other columns are ignored.  An empty
    table writes no file.  A task writes its files one after another, each under its final name only when whole.
    """
    folder = folder or run_folder(pages.sparkSession, "warc")

    def write(batches: Iterable) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        made = []

        def close() -> None:
            nonlocal number, held, size
            path = f"{folder}/pages-{task:06d}-{number:05d}.warc.gz"
            made.append((path, put_file(path, lambda out: out.write(b"".join(held)))))
            number, held, size = number + 1, [], 0

        count = 0
        for batch in batches:
            for page_id, url, payload, sha1, refers_to in zip(*(batch[c] for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                count += 1
                origin = uuid.uuid5(uuid.NAMESPACE_URL, f"{folder}/{task}/{count}").urn
                revisit = not pd.isna(refers_to)
                fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response")]
                fields += [("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode()), ("X-Payload-Length", str(len(payload)))]
                fields += [("X-Page-ID", str(int(page_id)))] if not pd.isna(page_id) else []
                fields += [("WARC-Target-URI", _line(url))] if isinstance(url, str) else []
                fields += [("WARC-Profile", PROFILE), ("X-Refers-To-Page-ID", str(int(refers_to)))] if revisit else []
                for data in segments(fields, origin, http_block(None if revisit else bytes(payload)), segment_bytes):
                    held.append(data)
                    size += len(data)
                    if size >= file_bytes:
                        close()
        if held:
            close()
        if made:
            yield pd.DataFrame(made, columns=["path", "bytes"])

    return stored(_with_revisits(pages, least).mapInPandas(write, "path string, bytes long"), "archives")


# Reading

_RECORD = (
    "origin string, segment int, total long, record_type string, page_id long, url string, refers_to long, "
    "stated_sha1 string, stated_bytes long, block binary"
)


def _sha1(digest: str) -> str | None:
    """Lower-case hex of a ``sha1:`` digest in base 32 or hex; None for any other."""
    value = digest[5:] if digest.lower().startswith("sha1:") else ""
    if re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return value.lower() if re.fullmatch("[0-9a-fA-F]{40}", value) else None


def _row(fields: dict[str, str], block: bytes | None) -> tuple:
    number = lambda name: _number(fields.get(name))
    origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id", "")
    segment = number("warc-segment-number")
    return (
        origin.strip("<>"), segment if segment is None or segment < 1 << 31 else None, number("warc-segment-total-length"), fields.get("warc-type"), number("x-page-id"),
        fields.get("warc-target-uri"), number("x-refers-to-page-id"), _sha1(fields.get("warc-payload-digest", "")), number("x-payload-length"), block,
    )


def _records(archives: DataFrame, segmented: bool) -> DataFrame:
    """The records of the files that are, or are not, segments."""

    def read(batches: Iterable) -> Iterator:
        import pandas as pd

        names = [c.split()[0] for c in _RECORD.split(", ")]
        whole = {"segment": "Int32", **{c: "Int64" for c in ("total", "page_id", "refers_to", "stated_bytes")}}
        for batch in batches:
            for path in batch["path"]:
                files, name = open_files(path)
                with files.open_input_file(name) as source:
                    rows, size = [], 0
                    for fields, block in read_records(source):
                        if ("warc-segment-number" in fields) == segmented:
                            rows.append(_row(fields, block))
                            size += len(block or b"")
                        if size > 4 << 20:
                            yield pd.DataFrame(rows, columns=names).astype(whole)
                            rows, size = [], 0
                    if rows:
                        yield pd.DataFrame(rows, columns=names).astype(whole)

    return archives.select("path").repartition(max(1, archives.count())).mapInPandas(read, _RECORD)


def reassembled(parts: DataFrame) -> DataFrame:
    """Segments to whole records, with ``complete``: numbers 1 to n without a gap or repeat, and the stated length.

    A group is the segments of one record.  Of a segment that occurs twice, one copy is used.  Blocks are joined once, in
    time linear in their length; a segment without block counts as empty, so its record lacks some of its length."""
    kept = ["record_type", "page_id", "url", "refers_to", "stated_sha1", "stated_bytes"]
    segment = F.struct("segment", "block", "total", F.struct(*kept).alias("head"))
    groups = parts.dropDuplicates(["origin", "segment", "block"]).groupBy("origin").agg(F.sort_array(F.collect_list(segment)).alias("s"))
    blocks = F.transform("s", lambda x: x["block"])
    joined = groups.withColumn("block", F.unhex(F.array_join(F.transform(blocks, F.hex), "")))
    numbers = F.transform("s", lambda x: x["segment"]) == F.sequence(F.lit(1), F.size("s"))
    complete = numbers & F.coalesce(F.element_at("s", -1)["total"] == F.octet_length("block"), F.lit(False))
    complete = F.coalesce(complete, F.lit(False))
    return joined.select("origin", *[F.element_at("s", 1)["head"][c].alias(c) for c in kept], "block", complete.alias("complete"))


def _payload(block: str):
    @F.pandas_udf("binary")
    def payload(blocks):
        import pandas as pd

        return pd.Series([None if b is None else http_payload(bytes(b)) for b in blocks], dtype=object)

    return payload(block)


def read_archives(archives: DataFrame) -> DataFrame:
    """``page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest, complete`` of every page.

    ``archives``: ``path``.  Digest (hex SHA-1) and length are those of the decoded payload, for revisits, which have
    none, those stated.  A record whose segments are missing, doubled or of another total length, whose framing is
    broken, which states no length or is cut short, is not ``complete`` and has no payload; a response whose payload has
    another digest than stated is not ``complete`` either.  Only segments are shuffled.
    """
    whole = _records(archives, segmented=False).withColumn("complete", F.col("block").isNotNull()).drop("segment", "total")
    records = whole.unionByName(reassembled(_records(archives, segmented=True)))
    decoded = records.withColumn("payload", F.when(F.col("complete") & (F.col("record_type") == "response"), _payload("block")))
    revisit = F.coalesce(F.col("record_type") == "revisit", F.lit(False))
    return decoded.select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        "payload",
        F.when(revisit, F.col("stated_bytes")).otherwise(F.octet_length("payload").cast("long")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_sha1")).otherwise(F.sha1("payload")).alias("payload_digest"),
        (F.col("complete") & (revisit | F.coalesce(F.sha1("payload") == F.col("stated_sha1"), F.lit(False)))).alias("complete"),
    )
