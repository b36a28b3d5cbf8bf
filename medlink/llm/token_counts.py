"""Token counts: an exact histogram of encoded lengths answers every context limit."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from medlink.llm.common import text_blocks
from medlink.llm.encode import encoder, tokenizer_path

#: Lengths that share one running sum; the sums of whole bands are added to it.
BAND = 1024


def encoded_lengths(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """One row per document: n_tokens, the length of its whole text. A null or empty text has 0 tokens."""
    path = path or tokenizer_path()

    def lengths(batches):
        coder = encoder(path)
        for batch in batches:
            counts = [n for block in text_blocks(batch.column(0)) for n in coder.lengths(block).tolist()]
            yield pa.RecordBatch.from_pydict({"n_tokens": pa.array(counts, pa.int64())})

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(lengths, "n_tokens long")


def length_counts(lengths: DataFrame, n_tokens: str = "n_tokens") -> DataFrame:
    """Documents of each length (n_tokens, n_docs), counted before any shuffle; null lengths are left out."""
    length = F.col(n_tokens).cast("long")
    return (
        lengths.where(length.isNotNull()).groupBy(length.alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))
    )


def length_histogram(counts: DataFrame) -> DataFrame:
    """One row of ``counts`` (see length_counts) per distinct length, with the answers for a context limit of just that many tokens.

    n_docs: documents of that length; docs_from, tokens_from: suffix sums, over documents at least so long;
    truncated_tokens: what is left of all documents cut to the limit; cut_docs: documents longer than the limit;
    docs_up_to_share: the quantile whose value is this length. An empty table gives no row.

    A hot length is one row a task after the counts. Suffix sums run within bands of
    1,024 lengths, plus the sums of the bands above; the bands are as few as the longest text has thousands.
    """
    counted = counts.withColumn("band", F.expr(f"n_tokens div {BAND}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    bands = counted.groupBy("band").agg(F.sum("n_docs").alias("band_docs"), F.sum(tokens).alias("band_tokens"))
    above = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    bands = bands.select(
        "band",
        F.coalesce(F.sum("band_docs").over(above), F.lit(0)).alias("docs_above"),
        F.coalesce(F.sum("band_tokens").over(above), F.lit(0)).alias("tokens_above"),
        F.sum("band_docs").over(whole).alias("all_docs"),
        F.sum("band_tokens").over(whole).alias("all_tokens"),
    )
    here = Window.partitionBy("band").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, 0)
    return (
        counted.join(bands, "band")
        .select(
            "n_tokens",
            "n_docs",
            (F.sum("n_docs").over(here) + F.col("docs_above")).alias("docs_from"),
            (F.sum(tokens).over(here) + F.col("tokens_above")).alias("tokens_from"),
            "all_docs",
            "all_tokens",
        )
        .withColumn("cut_docs", F.col("docs_from") - F.col("n_docs"))
        .withColumn(
            "truncated_tokens",
            F.col("all_tokens") - F.col("tokens_from") + F.col("n_tokens") * F.col("docs_from"),
        )
        .withColumn("docs_up_to_share", (F.col("all_docs") - F.col("cut_docs")) / F.col("all_docs"))
        .drop("all_docs", "all_tokens")
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: whole_docs, cut_docs, total_tokens and truncated_tokens, from the histogram alone."""
    total = F.sum(F.col("n_tokens") * F.col("n_docs"))
    per_limit = [
        F.struct(
            F.lit(int(limit)).cast("long").alias("context_limit"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") <= limit, F.col("n_docs"))), F.lit(0)).alias("whole_docs"),
            F.coalesce(F.sum(F.when(F.col("n_tokens") > limit, F.col("n_docs"))), F.lit(0)).alias("cut_docs"),
            F.coalesce(total, F.lit(0)).alias("total_tokens"),
            F.coalesce(F.sum(F.least("n_tokens", F.lit(limit)) * F.col("n_docs")), F.lit(0)).alias("truncated_tokens"),
        )
        for limit in limits
    ]
    return histogram.agg(F.array(*per_limit).alias("rows")).select(F.inline("rows"))


def length_quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """For each share, the smallest length that at least this share of the documents doesn't exceed."""
    picks = [
        F.struct(
            F.lit(float(share)).alias("share"),
            F.min(F.when(F.col("docs_up_to_share") >= share, F.col("n_tokens"))).alias("n_tokens"),
        )
        for share in shares
    ]
    return histogram.agg(F.array(*picks).alias("rows")).select(F.inline("rows"))
