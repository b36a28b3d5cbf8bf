"""Delimited files whose quoted fields hold line breaks, read by many tasks a file.

Whether a line break ends a record depends on everything before it in the file. So a first pass finds, for each split, how
it ends if it begins inside a quoted field and how if it doesn't; these answers, put one after the other along the file,
tell how every split begins. The second pass then cuts every split at true ends of records. What a record has in two splits
or more, the end of one and the beginning of the next, comes out as fragments, at most two a split, and is put together
afterwards. A quote opens a field only at its beginning; elsewhere in a field it is a sign like any other.

Lines are cut as bytes, as a line end is a single byte in UTF-8 and in the legacy code pages at hand; text is decoded line
by line, where it has quotes, and record by record.
"""

from __future__ import annotations

import codecs
import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Java's names of code pages that Python calls otherwise.
CODE_PAGES = {"MS950": "cp950", "X-WINDOWS-950": "cp950", "MS936": "cp936", "WINDOWS-1252": "cp1252"}
LINES = "file string, start long, line long, value binary"
#: kind: record; open (a split's last, unfinished record); rest (what continues an earlier split's record); middle (a
#: whole split inside one record).
PIECES = "file string, start long, line long, kind string, value binary"


def ends_inside(text: str, inside: bool, sep: str) -> bool:
    """Whether a line ends inside a quoted field, if it begins inside one or at the beginning of a field."""
    at = 0
    while True:
        if inside:
            at = text.find('"', at)
            if at < 0:
                return True
            if text[at + 1 : at + 2] == '"':  # a doubled quote is one within the field
                at += 2
                continue
            inside = False
        elif text[at : at + 1] == '"':
            inside, at = True, at + 1
            continue
        at = text.find(sep, at)
        if at < 0:
            return False
        at += 1


def _batch(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(part.split(" ") for part in schema.split(", ")))
    cols = list(zip(*rows)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(cols, types)], names=names)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the lines of each split; lines come in the order of the file."""
    current, line = None, 0
    for batch in batches:
        rows = []
        for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != current:
                current, line = (file, start), 0
            rows.append((file, start, line, value))
            line += 1
        yield _batch(LINES, rows)


def _cut(batches: Iterator[pa.RecordBatch], sep: str, code: str) -> Iterator[pa.RecordBatch]:
    """Join the lines of a split (file, start, line, value, inside: begins inside a record) to records and fragments."""
    current, held, first, odd, continues = None, [], 0, False, False

    def left() -> list[tuple]:
        if current is None or not held:
            return []
        return [(*current, first, "middle" if continues else "open", b"\n".join(held))]

    for batch in batches:
        rows = []
        for file, start, line, value, inside in zip(*(c.to_pylist() for c in batch.columns)):
            if (file, start) != current:
                rows += left()
                current, held, first, odd, continues = (file, start), [], line, inside, inside
            held.append(value)
            odd = ends_inside(value.decode(code, "replace"), odd, sep) if b'"' in value else odd
            if not odd:
                rows.append((file, start, first, "rest" if continues else "record", b"\n".join(held)))
                held, first, continues = [], line + 1, False
        yield _batch(PIECES, rows)
    yield _batch(PIECES, left())


def records(spark: SparkSession, paths: Sequence[str], sep: str, code: str) -> DataFrame:
    """(file, start, line, value): the bytes of every record and where it begins."""
    lines = spark.read.option("lineSep", "\n").text(list(paths)).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("value")
    )

    def ends(batches):
        found: dict[tuple[str, int], tuple[bool, bool]] = {}
        for batch in batches:
            for file, start, value in zip(*(c.to_pylist() for c in batch.columns)):
                outside, inside = found.get((file, start), (False, True))
                if b'"' in value:
                    text = value.decode(code, "replace")
                    outside, inside = ends_inside(text, outside, sep), ends_inside(text, inside, sep)
                found[file, start] = outside, inside
        yield _batch("file string, start long, outside long, within long", [(*k, *map(int, v)) for k, v in found.items()])

    # a row a split; then, for each file, how its splits begin, one after the other
    answers = lines.mapInArrow(ends, "file string, start long, outside long, within long")
    along = F.array_sort(F.collect_list(F.struct("start", "outside", "within")))
    begins = F.aggregate(
        "splits",
        F.struct(F.lit(0).cast("long").alias("now"), F.array().cast("array<long>").alias("inside")),
        lambda state, split: F.struct(
            F.when(state["now"] == 1, split["within"]).otherwise(split["outside"]).alias("now"),
            F.when(state["now"] == 1, F.concat(state["inside"], F.array(split["start"]))).otherwise(state["inside"]).alias("inside"),
        ),
    )
    inside = answers.groupBy("file").agg(along.alias("splits")).select("file", F.explode(begins["inside"]).alias("start"), F.lit(True).alias("inside"))
    placed = lines.mapInArrow(_numbered, LINES).join(inside, ["file", "start"], "left")
    placed = placed.select("file", "start", "line", "value", F.coalesce("inside", F.lit(False)).alias("inside"))
    # the join may have moved lines: of one split, not apart
    pieces = placed.sortWithinPartitions("file", "start", "line").mapInArrow(lambda batches: _cut(batches, sep, code), PIECES)
    parts = pieces.where("kind <> 'record'")
    # a fragment belongs to the last open one before it
    upto = Window.partitionBy("file").orderBy("start", "line")
    chains = parts.withColumn("chain", F.sum((F.col("kind") == "open").cast("int")).over(upto))
    piece = F.struct("start", "line", "value")
    whole = chains.groupBy("file", "chain").agg(F.array_sort(F.collect_list(piece)).alias("parts"))
    joined = F.aggregate(
        F.slice("parts", F.lit(2), F.size("parts")), F.get("parts", F.lit(0))["value"], lambda text, x: F.concat(text, F.lit(b"\n"), x["value"])
    )
    merged = whole.select("file", F.get("parts", F.lit(0))["start"].alias("start"), F.get("parts", F.lit(0))["line"].alias("line"), joined.alias("value"))
    return pieces.where("kind = 'record'").select("file", "start", "line", "value").unionByName(merged)


def parse(text: str, sep: str) -> list[str]:
    """The fields of one record."""
    return next(csv.reader(io.StringIO(text, newline=""), delimiter=sep), [])


def read_quoted(spark: SparkSession, paths: Sequence[str], sep: str, encoding: str = "UTF-8") -> DataFrame:
    """Text columns by the first file's header; each file's first record is its header. Missing values become ''.

    Blank lines outside quotes are skipped, surplus fields are left out. A quoted field that never ends is one field.
    """
    code = codecs.lookup(CODE_PAGES.get(encoding.upper(), encoding)).name
    head = records(spark, paths[:1], sep, code).where("start = 0 and line = 0").first()
    names = parse(bytes(head["value"]).decode(code).removeprefix("﻿").rstrip("\r"), sep) if head else []
    if not names:
        return spark.createDataFrame([], "value string").select()

    def fields(batches):
        for batch in batches:
            rows = []
            for value in batch.column(0).to_pylist():
                row = parse(value.decode(code, "replace").rstrip("\r"), sep)
                if row:
                    rows.append((row + [""] * len(names))[: len(names)])
            cols = list(zip(*rows)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], names=[f"c{i}" for i in range(len(names))])

    body = records(spark, paths, sep, code).where("start > 0 or line > 0").select("value")
    parsed = body.mapInArrow(fields, ", ".join(f"c{i} string" for i in range(len(names))))
    return parsed.toDF(*names)
