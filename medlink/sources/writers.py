"""Sinks: batches with provenance, atomic releases, upserts, exports and reports."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlink.operators.keyed import upsert


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def write_small_text(spark: SparkSession, path: str, text: str) -> None:
    """A few lines written by the driver: put beside the target, then renamed onto it in one step.

    Readers see the old text or the new one, as the rename replaces the target.
    """
    fs, target = _fs(spark, path)
    _, side = _fs(spark, path + ".tmp")
    out = fs.create(side, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    options = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 1)
    options[0] = getattr(hadoop, "Options$Rename").OVERWRITE
    context = hadoop.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(fs.makeQualified(side), fs.makeQualified(target), options)


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, target = _fs(spark, path)
    fs.delete(target, True)


def read_small_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r.value for r in spark.read.text(path).collect())


def with_row_numbers(df: DataFrame, start: int = 1) -> DataFrame:
    """Consecutive ``row_number`` in partition order without moving any row.

    ``monotonically_increasing_id`` carries the partition in its high bits; the driver
    only sees one count per partition.
    """
    tagged = df.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = {r.p: r.n for r in tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    shift, rows = start, []
    for p in sorted(counts):
        rows.append((p, shift))
        shift += counts[p]
    if not rows:
        return df.withColumn("row_number", F.lit(None).cast("long"))
    table = df.sparkSession.createDataFrame(rows, "_p long, _shift long")
    inside = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("_p", part)
        .join(F.broadcast(table), "_p")
        .withColumn("row_number", inside + F.col("_shift"))
        .drop("_p", "_id", "_shift")
    )


def write_batch(
    df: DataFrame,
    path: str,
    batches_path: str,
    batch_id: str,
    source_name: str,
    source_version: str,
    imported_at: str,
    notes: str | None = None,
    max_records_per_file: int = 5_000_000,
) -> int:
    """Append one import batch under its own partition, then record it with its row count.

    A batch folder is replaced as a whole, so a repeated or resumed load gives one copy. Rows are written once before
    they are numbered: numbers come from files, which read the same each time, not from two runs of a plan.
    """
    spark = df.sparkSession
    target, side = f"{path}/import_batch_id={batch_id}", f"{path}/_unnumbered-{batch_id}"
    df.write.mode("overwrite").parquet(side)
    with_row_numbers(spark.read.parquet(side)).write.mode("overwrite").option("maxRecordsPerFile", max_records_per_file).parquet(target)
    delete_folder(spark, side)
    rows = spark.read.parquet(target).count()
    record = spark.createDataFrame(
        [(source_name, source_version, imported_at, rows, notes)],
        "source_name string, source_version string, imported_at string, row_count long, notes string",
    )
    record.coalesce(1).write.mode("overwrite").parquet(f"{batches_path}/import_batch_id={batch_id}")
    return rows


def replace_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def publish_release(
    spark: SparkSession, tables: dict[str, DataFrame], root: str, release: str, carried: dict[str, str] | None = None
) -> None:
    """Write every table under a new release folder; readers switch when the pointer moves.

    The pointer names the release and the folder of each of its tables; ``carried`` are tables of earlier releases that
    stay as they are.
    """
    folders = dict(carried or {})
    for name, df in tables.items():
        folders[name] = f"release={release}/{name}"
        df.write.mode("overwrite").parquet(f"{root}/{folders[name]}")
    write_small_text(spark, f"{root}/CURRENT", json.dumps({"release": release, "tables": folders}, sort_keys=True))


def _pointer(spark: SparkSession, root: str) -> dict:
    return json.loads(read_small_text(spark, f"{root}/CURRENT"))


def has_release(spark: SparkSession, root: str) -> bool:
    fs, pointer = _fs(spark, f"{root}/CURRENT")
    return fs.exists(pointer)


def current_release(spark: SparkSession, root: str) -> str:
    return _pointer(spark, root)["release"]


def release_tables(spark: SparkSession, root: str) -> dict[str, str]:
    """The current release's tables and their folders."""
    return _pointer(spark, root)["tables"]


def read_release(spark: SparkSession, root: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{_pointer(spark, root)['tables'][table]}")


def upsert_table(spark: SparkSession, incoming: DataFrame, keys: Sequence[str], root: str, table: str, release: str) -> None:
    """Upsert into a released table: the merged table is written beside the old one, then switched to.

    The release's other tables are carried over. The new release needs a name of its own.
    """
    pointer = _pointer(spark, root)
    if pointer["release"] == release or pointer["tables"][table].startswith(f"release={release}/"):
        raise ValueError(f"release {release!r} is what would be read; choose another name")
    merged = upsert(read_release(spark, root, table), incoming, keys)
    publish_release(spark, {table: merged}, root, release, pointer["tables"])


#: Rows of a file of a sorted table.
SORTED_FILE_ROWS = 2_000_000


def write_sorted(df: DataFrame, path: str, order: Sequence[str], file_format: str = "parquet", **options) -> int:
    """Write a table in one global order; returns the number of files.

    Ranges are dealt over the cluster and sorted each for itself, so the files, taken by name, hold the rows in ``order``
    from the first to the last (nulls first), and reading one after the other needs no sort. Rows equal in ``order`` lie
    in any order, and all in one file. A repeated run replaces the folder.
    """
    files = max(1, -(-df.count() // SORTED_FILE_ROWS))
    keys = [F.col(f"`{c}`").asc_nulls_first() for c in order]
    ranged = df.repartitionByRange(files, *keys) if files > 1 else df.coalesce(1)
    ranged.sortWithinPartitions(*keys).write.mode("overwrite").options(**options).format(file_format).save(path)
    return files


def content_hash(df: DataFrame) -> str:
    """Order-free SHA-256 of all rows: of the exact sums of the rows' own SHA-256, in four parts.

    A row is hashed as JSON with its nulls written out, so (null, a) and (a, null) differ.
    """
    row = F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)]), {"ignoreNullFields": "false"}), 256)
    part = lambda i: F.conv(F.substring("h", 16 * i + 1, 16), 16, 10).cast("decimal(38,0)")
    sums = df.select(row.alias("h")).agg(*[F.coalesce(F.sum(part(i)), F.lit(0)).alias(f"s{i}") for i in range(4)]).first()
    return hashlib.sha256("/".join(str(s) for s in sums).encode()).hexdigest()


def export_with_manifest(
    df: DataFrame, path: str, table: str, keys: DataFrame | None = None, key: str | None = None
) -> dict[str, object]:
    """Write, read back, compare counts, look up sample keys, and record schema and content hash."""
    spark = df.sparkSession
    rows = df.count()
    df.write.mode("overwrite").parquet(f"{path}/{table}")
    back = spark.read.parquet(f"{path}/{table}")
    manifest = {
        "table": table,
        "row_count": rows,
        "exported_rows": back.count(),
        "content_sha256": content_hash(back),
        "columns": [{"column": n, "type": t} for n, t in back.dtypes],
    }
    if keys is not None and key is not None:
        manifest["sample_keys"] = keys.select(key).distinct().count()
        manifest["sample_key_hits"] = back.select(key).distinct().join(keys.select(key), key, "left_semi").count()
    if manifest["exported_rows"] != rows:
        raise OSError(f"{table}: wrote {rows} rows, read back {manifest['exported_rows']}")
    write_small_text(spark, f"{path}/{table}.manifest.json", json.dumps(manifest, indent=2, sort_keys=True) + "\n")
    return manifest


def write_report(
    spark: SparkSession, summary: DataFrame, details: dict[str, DataFrame], path: str, title: str, order: dict[str, Sequence[str]] | None = None
) -> None:
    """One-row summary as Markdown and CSV, bounded detail tables as CSV, in the order given for them or of their columns."""
    row = summary.first().asDict()
    lines = [f"# {title}", "", *[f"- {name}: {value}" for name, value in row.items()], ""]
    write_small_text(spark, f"{path}/report.md", "\n".join(lines))
    summary.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{path}/summary")
    for name, df in details.items():
        write_sorted(df, f"{path}/{name}", (order or {}).get(name, df.columns), "csv", header=True)


def write_json_summary(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
