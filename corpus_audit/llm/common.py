"""Small helpers shared by the operators: tables, shared folders, stored intermediate results, files by URI."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import sys
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_audit.operators import numbering

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
LOWERED = str.maketrans(UPPER, LOWER)
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[str]:
    """A-Z lower-cased; words are runs of 0-9, a-z and characters beyond ASCII.  Null has none."""
    return WORD.findall(text.lower() if text.isascii() else text.translate(LOWERED)) if text else []


_kept: dict[str, dict] = {}


def worker_cache(operator: str) -> dict:
    """What an operator keeps in a worker process from batch to batch.

    Workers outlive stages, and a pipeline's operators follow each other in the same ones: the first call of another
    operator drops what was kept, and returns the memory, also what Arrow's pool holds of freed batches."""
    if operator not in _kept:
        _kept.clear()
        _kept[operator] = {}
        gc.collect()
        if "pyarrow" in sys.modules:
            sys.modules["pyarrow"].default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)
    return _kept[operator]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a local session without one gets a new one, others an error."""
    folder = numbering.shared_folder(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def text_batches(spark: SparkSession, rows: int = 512) -> None:
    """Have at most so many rows sent to Python at once: rows here are whole texts, and Spark's usual 10,000 of them
    take hundreds of megabytes in each worker.  The session keeps the setting, as plans read it when they run; a smaller one
    stays."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def run_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one run, below the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe when executors are lost."""
    path = run_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def lower_ascii(column) -> F.Column:
    """A-Z lower-cased; other letters stay."""
    return F.translate(column, UPPER, LOWER)


def open_files(uri: str):
    """The file system of a URI, and the path in it; for file, hdfs and object store URIs alike."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = os.path.abspath(uri)
    elif uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def put_file(uri: str, write) -> int:
    """Create a file by ``write(stream)`` under another name, then give it its name, so that a task which runs
    twice leaves one whole file.  Returns its length."""
    files, path = open_files(uri)
    files.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with files.open_output_stream(draft) as stream:
        write(stream)
        length = stream.tell()
    files.move(draft, path)
    return length
