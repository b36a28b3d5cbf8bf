"""Helpers shared by the operators: the shared folder, stored tables and blocks of texts."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of text that a Python task works on at a time.
BLOCK_CHARS = 500_000


#: What a Python worker keeps from task to task, by name. Workers serve tasks of many stages, so it is let go (see
#: let_go) as soon as a task of another kind begins.
KEPT: dict[str, object] = {}


def let_go() -> None:
    """Free what earlier tasks of this worker have kept."""
    if KEPT:
        KEPT.clear()
        gc.collect()
        trim()


def trim() -> None:
    """Give freed memory back to the system, as idle workers would hold it; a C library without this keeps it longer."""
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


#: Documents of an Arrow batch: both sides of a Python task hold a batch whole, and texts may be long.
BATCH_ROWS = 1000


def short_batches(spark: SparkSession) -> None:
    """From now on this session hands tables to Python tasks in batches of BATCH_ROWS rows, or fewer if it did already."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which the driver and all executors see.

    A local session without the setting (tests) gets a temporary folder; a cluster without it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/llm-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", by: str | None = None) -> DataFrame:
    """Write a table into the shared folder and read it again: lineage ends there, and a lost executor loses nothing.

    ``by``: a column of few values, each of which gets files of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, mod 4, is 2. A null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def uniform(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys only."""
    return (F.xxhash64(*keys).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))).cast("double")


def blocks_of(texts: Iterable[str], limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Whole texts in order, in blocks of about ``limit`` characters; a longer text is a block."""
    block, size = [], 0
    for text in texts:
        if block and size + len(text) > limit:
            yield block
            block, size = [], 0
        block.append(text)
        size += len(text)
    if block:
        yield block


def text_blocks(texts: pa.Array, limit: int = BLOCK_CHARS) -> Iterator[list[str]]:
    """Blocks of an Arrow column; null as empty."""
    yield from blocks_of((text.as_py() or "" for text in texts), limit)
    trim()
