"""Keyed picks, positions and lookups that stay balanced under skew.

Every pick is an aggregate (``min_by``/``max_by``), never a window with
``row_number() = 1``: aggregates combine on the map side, so a key that holds a
third of all rows reaches the shuffle as one row per task.
"""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pick(df: DataFrame, keys: Sequence[str], order: Sequence[Column], last: bool = False) -> DataFrame:
    """One whole row per key: the smallest (or largest) by ``order``.

    Nulls sort first.  Callers append a business key to ``order`` so that ties
    always resolve the same way.
    """
    rest = [c for c in df.columns if c not in keys]
    choose = F.max_by if last else F.min_by
    row = choose(F.struct(*[F.col(f"`{c}`") for c in rest]), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(row).select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])


def latest_version(df: DataFrame, key: str, start: str, end: str, ties: Sequence[str]) -> DataFrame:
    """Newest row per key by (start, end): a missing start is oldest, a missing end newest."""
    order = [F.col(start), F.col(end).isNull(), F.col(end), *[F.col(t) for t in ties]]
    return pick(df.where(F.trim(F.col(key).cast("string")) != ""), [key], order, last=True)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Keep-first de-duplication under an explicit order."""
    return pick(df, keys, [F.col(o) for o in order])


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; the explode keeps filters on what is made of a value above it, or each row would be worked out for them."""
    return df.select(column).distinct().select(F.explode(F.array(column)).alias(column))


def overlay(base: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Lookup overlay: rows of ``top`` replace rows of ``base`` with the same key."""
    kept = base.join(top.select(key).distinct(), key, "left_anti")
    return kept.unionByName(top, allowMissingColumns=True)


HOT_ROWS = 1_000_000
#: Keys are counted by so many hashes first.
HASHES = 65_536


def hot_keys(df: DataFrame, keys: Sequence[str], limit: int = HOT_ROWS) -> DataFrame | None:
    """The keys of more than ``limit`` rows, None if there are none.

    Rows are counted by a hash of their key, so a task hands on at most HASHES numbers and not its keys; just the keys of
    a hash with more than ``limit`` rows are counted themselves.
    """
    rows = F.count(F.lit(1)).alias("_n")
    hashed = df.withColumn("_hash", F.pmod(F.xxhash64(*keys), F.lit(HASHES)))
    full = [r["_hash"] for r in hashed.groupBy("_hash").agg(rows).where(F.col("_n") > limit).collect()]
    if not full:
        return None
    hot = checkpointed(hashed.where(F.col("_hash").isin(full)).groupBy(*keys).agg(rows).where(F.col("_n") > limit).select(*keys))
    return None if hot.isEmpty() else hot


def hot_band(df: DataFrame, keys: Sequence[str], band: Column, limit: int = HOT_ROWS) -> Column | None:
    """``band`` if some key is too large for one task, else None (then a plain window is cheaper)."""
    return band if hot_keys(df, keys, limit) is not None else None


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut lineage in the cluster's shared checkpoint folder, so later branches do not recompute."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", "")
        if not folder:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="spark-")
        sc.setCheckpointDir(folder)
    return df.checkpoint()


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    value: Column,
    out: str,
    band: Column | None,
    how: str = "sum",
    include_current: bool = True,
) -> DataFrame:
    """Running sum or maximum of ``value`` along ``order`` inside each key.

    Without ``band`` this is a plain window.  ``band`` is any expression that never
    decreases along ``order``: the rows of one key are then scanned band by band in
    separate tasks and combined with the total of the earlier bands, so a hot key is not
    sorted in one place.  The band totals are a map-side-combined aggregate with one row
    per (key, band).
    """
    combine = {"sum": F.sum, "max": F.max}[how]
    until = Window.currentRow if include_current else -1
    if band is None:
        whole = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
        return df.withColumn(out, combine(value).over(whole))
    banded = df.withColumns({"_band": band, "_value": value})
    before = Window.partitionBy(*keys).orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    totals = banded.groupBy(*keys, "_band").agg(combine("_value").alias("_total"))
    earlier = totals.select(*keys, "_band", combine("_total").over(before).alias("_earlier"))
    inside = Window.partitionBy(*keys, "_band").orderBy(*order).rowsBetween(Window.unboundedPreceding, until)
    here = combine("_value").over(inside)
    if how == "sum":
        merged = F.coalesce("_inside", F.lit(0)) + F.coalesce("_earlier", F.lit(0))
    else:
        merged = F.greatest("_inside", "_earlier")
    return (
        banded.withColumn("_inside", here)
        .join(earlier, [*keys, "_band"])
        .withColumn(out, merged)
        .drop("_band", "_value", "_inside", "_earlier")
    )


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "position",
    band: Column | None = None,
) -> DataFrame:
    """1-based position of each row inside its key; with ``band``, balanced under hot keys."""
    if band is None:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return running(df, keys, order, F.lit(1).cast("long"), out, band)


def chunked_lists(
    df: DataFrame, keys: Sequence[str], position: str, item: Column, out: str, chunk: int = 1000
) -> DataFrame:
    """Ordered lists of at most ``chunk`` items: rows (keys, chunk_no, out).

    A key with up to ``chunk`` items gives one list; a larger one gives several
    rows, so no row and no task ever holds an unbounded group.
    """
    chunk_no = F.floor((F.col(position) - 1) / chunk).cast("int").alias("chunk_no")
    pairs = df.select(*keys, chunk_no, F.struct(F.col(position).alias("p"), item.alias("v")).alias("_item"))
    packed = pairs.groupBy(*keys, "chunk_no").agg(F.array_sort(F.collect_list("_item")).alias("_items"))
    return packed.select(*keys, "chunk_no", F.transform("_items", lambda x: x["v"]).alias(out))


def left_lookup(df: DataFrame, lookup: DataFrame, key: str, spread_by: str, copies: int = 1024) -> DataFrame:
    """Left join on ``key`` where many rows have no key: those are spread instead of sharing one null."""
    filler = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(spread_by), F.lit(copies)).cast("string"))
    keyed = df.withColumn("_lookup_key", F.coalesce(F.col(key), filler))
    return keyed.join(lookup.withColumnRenamed(key, "_lookup_key"), "_lookup_key", "left").drop("_lookup_key")


def spread_join(df: DataFrame, lookup: DataFrame, key: str, spread_by: str, copies: int = 16) -> DataFrame:
    """Join on ``key`` where a few keys may have most rows: their rows go to ``copies`` places, each with the key's rows of ``lookup``."""
    place = F.pmod(F.xxhash64(spread_by), F.lit(copies)).cast("int")
    copied = lookup.withColumn("_place", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return df.withColumn("_place", place).join(copied.hint("merge"), [key, "_place"]).drop("_place")


def upsert(current: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``incoming`` replace rows of ``current`` with the same key."""
    kept = current.join(incoming.select(*keys).distinct(), list(keys), "left_anti")
    return kept.unionByName(incoming, allowMissingColumns=True)


def anti_insert(current: DataFrame, incoming: DataFrame, signature: Sequence[str]) -> DataFrame:
    """Incoming rows whose signature (null-safe) is not among the current rows."""
    known = current.select(*[F.col(c).alias(f"_{c}") for c in signature]).distinct()
    match = None
    for c in signature:
        test = F.col(c).eqNullSafe(F.col(f"_{c}"))
        match = test if match is None else match & test
    return incoming.join(known, match, "left_anti")
