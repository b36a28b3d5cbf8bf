"""Exact duplicates by Grace hashing: partition by a hash of the content, spill, compare whole contents in a table.

Level 0 reads the rows where they lie. Every task keeps an open-addressing table of the contents it has met, of a bounded
size, and writes one record for each content in it (its representative), with the rows it stands for beside it. So a
content that fills a third of all rows leaves a task as one record a table, before anything is shuffled.

Each further level partitions the open records into buckets by a prefix of their content's hash. A task reads a bucket
into a table of the same bounded size; records equal to an entry join it. When the table is full, the records equal to no
entry are spilled, to files in the shared folder, and the next level partitions just these by a longer prefix. An entry of
a full table has met every copy of its content in the bucket, and no spilled content is in it: each bucket's work is final,
and every level settles at least a table of each bucket, even where all hashes are equal.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.llm.common import stored

#: Bytes of different contents that a table holds; a longer content has a table of its own.
TABLE_BYTES = 64 << 20
#: Rows turned into Python objects at a time.
SLICE_ROWS = 512
#: Bits of the hash of which buckets take a prefix.
HASH_BITS = 60

RECORD = "rep long, doc_id long, row long, n long, digest string, mark long, text string"


class ContentTable:
    """Open addressing with linear probing; equal means equal in hash and in every byte."""

    def __init__(self, room: int):
        self.room = room
        self.clear()

    def clear(self) -> None:
        self.slots = [-1] * 1024
        self.marks: list[int] = []
        self.contents: list[bytes] = []
        self.used = 0
        self.full = False

    def _slot(self, mark: int) -> int:
        return (mark * 0x9E3779B97F4A7C15 >> 20) & (len(self.slots) - 1)

    def find_or_add(self, mark: int, content: bytes) -> int:
        """The number of the entry with this content, added if it is new and there is room; else -1."""
        slots, last = self.slots, len(self.slots) - 1
        at = self._slot(mark)
        while (entry := slots[at]) >= 0:
            if self.marks[entry] == mark and self.contents[entry] == content:
                return entry
            at = (at + 1) & last
        if self.contents and self.used + len(content) > self.room:
            self.full = True
        if self.full:
            return -1
        slots[at] = len(self.contents)
        self.marks.append(mark)
        self.contents.append(content)
        self.used += len(content)
        if 2 * len(self.contents) > len(slots):
            self._grow()
        return len(self.contents) - 1

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        last = len(self.slots) - 1
        for entry, mark in enumerate(self.marks):
            at = self._slot(mark)
            while self.slots[at] >= 0:
                at = (at + 1) & last
            self.slots[at] = entry


_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string())
_NAMES = tuple(part.split(" ")[0] for part in RECORD.split(", "))


def _records(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Record batches of at most SLICE_ROWS records, as texts may be long."""
    for low in range(0, len(rows), SLICE_ROWS):
        cols = list(zip(*rows[low : low + SLICE_ROWS]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Iterator[tuple]]:
    """Slices of rows; the column text as UTF-8 bytes."""
    for batch in batches:
        for low in range(0, batch.num_rows, SLICE_ROWS):
            part = batch.slice(low, SLICE_ROWS)
            cols = [c.cast(pa.binary()) if n == "text" else c for n, c in zip(part.schema.names, part.columns)]
            yield zip(*(c.to_pylist() for c in cols))


def _least(a: tuple, b: tuple) -> tuple:
    """The one of two (doc_id, row) that stays: the smaller id, any id before null, then the earlier row."""
    return min(a, b, key=lambda x: (x[0] is None, x[0] or 0, x[1]))


def _gather(room: int):
    """Level 0: columns doc_id, digest, mark, text to records; rows of an entry have no text, its own record has."""

    def run(batches):
        base = TaskContext.get().partitionId() << 33
        table, firsts, groups, row = ContentTable(room), [], [], base

        def flush():
            done = [(rep, *keep, n, digest, mark, text.decode()) for (rep, digest), (keep, n), mark, text in zip(firsts, groups, table.marks, table.contents)]
            table.clear()
            firsts.clear()
            groups.clear()
            return _records(done)

        for rows in _rows(batches):
            members = []
            for doc_id, digest, mark, text in rows:
                entry = table.find_or_add(mark, text)
                if entry < 0:
                    yield from flush()
                    entry = table.find_or_add(mark, text)
                if entry == len(groups):
                    firsts.append((row, digest))
                    groups.append(((doc_id, row), 1))
                else:
                    keep, n = groups[entry]
                    groups[entry] = (_least(keep, (doc_id, row)), n + 1)
                members.append((firsts[entry][0], doc_id, row, None, None, None, None))
                row += 1
            yield from _records(members)
        yield from flush()

    return run


def _settle(room: int):
    """A level: records sorted by bucket to settled ones (without text; the group's kept row and size) and spilled ones."""

    def run(batches):
        table, groups, joined, current = ContentTable(room), [], [], None

        def flush():
            done = [(rep, *groups[e][0], groups[e][1], groups[e][2], None, None) for rep, e in joined]
            table.clear()
            groups.clear()
            joined.clear()
            return _records(done)

        for rows in _rows(batches):
            spilled = []
            for bucket, rep, doc_id, row, n, digest, mark, text in rows:
                if bucket != current:
                    yield from flush()
                    current = bucket
                entry = table.find_or_add(mark, text)
                if entry < 0:
                    spilled.append((rep, doc_id, row, n, digest, mark, text.decode()))
                    continue
                if entry == len(groups):
                    groups.append(((doc_id, row), n, digest))
                else:
                    keep, size, _ = groups[entry]
                    groups[entry] = (_least(keep, (doc_id, row)), size + n, digest)
                joined.append((rep, entry))
            yield from _records(spilled)
        yield from flush()

    return run


def normalised(text: Column) -> Column:
    """The content that counts: each run of white space as one space, null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def hash_of(digest: Column) -> Column:
    """HASH_BITS bits of a hexadecimal digest."""
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def dedup(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    table_bytes: int = TABLE_BYTES,
    hashed=hash_of,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised content, lower-case hex).

    Documents of equal content form a group; its row with the smallest doc_id stays (keep_id). Null texts count as empty,
    so they are equal to empty ones. A null doc_id comes after all others: keep_id is null only where the group has no id.
    Of rows that share the smallest id of a group, one is kept. An empty table gives no row; other columns don't matter.
    ``hashed`` makes the hash, a long below 2 ** HASH_BITS, of the digest; the result doesn't depend on it.
    """
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), normalised(F.col(text)).alias("text"))
    keyed = whole.withColumn("digest", F.sha2("text", 256))
    keyed = keyed.select("doc_id", "digest", hashed(F.col("digest")).alias("mark"), "text")
    gathered = stored(keyed.mapInArrow(_gather(table_bytes), RECORD), "gathered")
    members = gathered.where("text is null").select("rep", F.col("doc_id").alias("id"), F.col("row").alias("own_row"))
    spilled, settled, bits = gathered.where("text is not null"), None, 0
    while True:
        size = spilled.agg(F.sum(F.octet_length("text") + F.lit(1))).first()[0]
        if not size:
            break
        parts = math.ceil(2 * size / table_bytes)
        bits = min(HASH_BITS, max(bits + 4 if bits else 0, math.ceil(math.log2(parts)) + 1))
        bucket = F.shiftright("mark", HASH_BITS - bits)
        ordered = spilled.select(bucket.alias("bucket"), *_NAMES).repartition(parts, "bucket").sortWithinPartitions("bucket")
        level = stored(ordered.mapInArrow(_settle(table_bytes), RECORD), "level")
        done = level.where("text is null")
        settled = done if settled is None else settled.unionByName(done)
        spilled = level.where("text is not null")
    if settled is None:
        settled = gathered.limit(0)
    groups = settled.select("rep", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), F.col("n").alias("group_size"), "digest")
    return members.join(groups, "rep").select(
        F.col("id").alias("doc_id"),
        "keep_id",
        "group_size",
        (F.col("own_row") == F.col("keep_row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )
