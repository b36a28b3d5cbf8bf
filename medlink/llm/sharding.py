"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Places within a shard are numbered in this many slices, each small enough for a task; a power of 16.
SLICES = 4096


def _hash(key: Column, salt: Column) -> Column:
    """60 bits of the MD5 of key and salt, as a long."""
    return F.conv(F.substring(F.md5(F.concat(key, F.lit("#"), salt)), 1, 15), 16, 10).cast("long")


def rendezvous(key: Column, weights: dict[int, float]) -> Column:
    """The shard that scores highest for the key.

    A shard's score, -weight / ln(u), depends on the key and that shard alone (u: a hash as a number in (0, 1)).
    So one more shard, or more weight of one, moves records only into that shard, and takes each shard's share in
    proportion to the weights. With equal weights the hash itself orders the shards. Ties go to the larger shard.
    A null key counts as the text "null"; shards of weight 0 get nothing.
    """
    key = F.coalesce(key.cast("string"), F.lit("null"))
    shards = [s for s, w in sorted(weights.items()) if w > 0]
    if not shards:
        raise ValueError("a shard with a weight above 0 is needed")
    equal = len({weights[s] for s in shards}) == 1

    def score(shard: int) -> Column:
        hashed = _hash(key, F.lit(str(shard)))
        return hashed if equal else -F.lit(float(weights[shard])) / F.log((hashed + 0.5) / F.lit(float(1 << 60)))

    scores = [F.struct(score(s).alias("score"), F.lit(s).cast("int").alias("shard")) for s in shards]
    return (F.greatest(*scores) if len(scores) > 1 else scores[0])["shard"]


def with_slots(df: DataFrame, key: str, shard: str = "shard", ties: list[str] | None = None) -> DataFrame:
    """Number the rows of each shard from 0 without gaps, as column slot.

    Rows are ordered by a slice (a hash of the key), then by key, then by ``ties``. Rows equal in all of these form a group
    and are numbered in any order, each partition of the input for itself. What lies before a group in its slice, and
    before a slice in its shard, comes from counts, so no task holds a shard, nor all rows of a hot key.
    """
    digits, ties = len(f"{SLICES - 1:x}"), ties or []
    text = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    group = ["slice", "_group", "_part"]
    rows = df.withColumns(
        {
            "slice": F.substring(F.md5(text), 1, digits),
            "_group": F.xxhash64(text, *ties),
            "_part": F.spark_partition_id(),
        }
    )
    counts = rows.groupBy(shard, *group, key, *ties).agg(F.count(F.lit(1)).alias("_n"))
    ahead = lambda *order: Window.partitionBy(shard, "slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_n").over(ahead(key, *ties, "_part")), F.lit(0)).alias("_inside")
    slices = counts.groupBy(shard, "slice").agg(F.sum("_n").alias("_rows"))
    before = Window.partitionBy(shard).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select(shard, "slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    starts = counts.select(shard, *group, *[F.col(c).alias(f"_{c}") for c in (key, *ties)], inside).join(slices, [shard, "slice"])
    own = Window.partitionBy(shard, *group, key, *ties).orderBy(F.lit(1))
    numbered = rows.withColumn("_number", F.row_number().over(own) - 1)
    same = [numbered[c] == starts[c] for c in (shard, *group)] + [numbered[c].eqNullSafe(starts[f"_{c}"]) for c in (key, *ties)]
    return numbered.join(starts, same).select(
        *[numbered[c] for c in df.columns], (F.col("_number") + F.col("_inside") + F.col("_before")).alias("slot")
    )


def shard_documents(
    docs: DataFrame,
    n_shards: int = 24,
    weights: dict[int, float] | None = None,
    key: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per document: doc_id (the key), size, text_crc32, law ("key"), shard, slot, grown_shard.

    size: UTF-8 bytes of the text (null: none) plus 8. text_crc32: of the UTF-8 text, null as empty. grown_shard: the
    shard when one more joins with weight 1. Repeated rows of a key share its shard; an empty table gives no row.
    """
    weights = weights or {s: 1.0 for s in range(n_shards)}
    grown = weights | {max(weights) + 1: 1.0}
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + F.lit(8)).cast("long").alias("size"),
        F.crc32(F.encode(whole, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), grown).alias("grown_shard"),
    )
    return with_slots(rows, "doc_id", ties=["text_crc32", "size"]).select(
        "doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard"
    )
