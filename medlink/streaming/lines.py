"""Match a stream of lines against the stored index of a dictionary.

All state is per line or per case inside one micro-batch, so the stream needs no state store: each batch runs the batch
operators in ``foreachBatch``.  The index is read from its release; when the release pointer moves, the next batch reads
the new one.  No batch builds an index.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from medlink.operators.interactions import evaluate_cases
from medlink.operators.match_index import MatchIndex, index_release, read_index
from medlink.operators.matching import match_lines
from medlink.sources.writers import delete_folder


class IndexReader:
    """The current release's index; files are looked up again only when the pointer names another release."""

    def __init__(self, root: str):
        self.root = root
        self.release: str | None = None
        self.index: MatchIndex | None = None

    def current(self, spark: SparkSession) -> MatchIndex:
        release = index_release(spark, self.root)
        if release != self.release:
            self.index, self.release = read_index(spark, self.root), release
        return self.index


@dataclass(frozen=True)
class Evaluation:
    """What the coverage evaluation of each batch's cases needs beside their matches."""

    product_ingredients: DataFrame
    concepts: DataFrame
    pairs: DataFrame


def evaluate_matches(matches: DataFrame, known: Evaluation) -> dict[str, DataFrame]:
    """Coverage evaluation of matched cases: their products, their ingredients found without one, and unmatched lines."""
    codes = matches.where("product_id is not null").select(
        "case_id", F.col("product_id").alias("product_code"), F.col("input_index").alias("position")
    )
    ids = matches.where("product_id is null and ingredient_id is not null").select("case_id", "ingredient_id")
    texts = matches.where("match_status = 'unmatched'").select("case_id", F.col("input_text").alias("raw_text"))
    return evaluate_cases(codes, ids, texts, known.product_ingredients, known.concepts, known.pairs)


def match_stream(
    lines: DataFrame,
    index_root: str,
    out_path: str,
    checkpoint: str,
    evaluation: Evaluation | None = None,
    then: Callable[[DataFrame, int], None] | None = None,
    available_now: bool = False,
) -> StreamingQuery:
    """Write the match rows of every micro-batch under ``out_path/matches/batch_id=N``.

    lines(case_id, input_index, input_text); the lines of a case come in one batch.  With ``evaluation`` the tables of
    the coverage evaluation follow under ``out_path/<table>/batch_id=N``.  A batch that is replayed after a failure
    overwrites its own folders, so each line is written once.  ``then`` may run further batch operators on the matched rows.
    """
    reader = IndexReader(index_root)

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        side, target = f"{out_path}/_texts/{batch_id}", f"{out_path}/matches/batch_id={batch_id}"

        def store(texts: DataFrame) -> DataFrame:
            texts.write.mode("overwrite").parquet(side)
            return spark.read.schema(texts.schema).parquet(side)

        match_lines(batch, reader.current(spark), store=store).write.mode("overwrite").parquet(target)
        delete_folder(spark, side)
        matches = spark.read.parquet(target)
        if evaluation is not None:
            for name, df in evaluate_matches(matches, evaluation).items():
                df.write.mode("overwrite").parquet(f"{out_path}/{name}/batch_id={batch_id}")
        if then is not None:
            then(matches, batch_id)

    writer = lines.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
