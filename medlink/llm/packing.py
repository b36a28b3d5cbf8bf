"""Bulk-synchronous best-fit packing of token pieces into sequences.

Each round sorts open documents and gaps by size over the cluster, largest first, a gap before documents of its size.
Reading down that order, a document takes the gap passed last: the smallest that is large enough and still free, its
successor. Every task sweeps its own range so. What is left in the ranges (documents that need a gap of an earlier range,
gaps for documents of a later one) is matched from the ranges' counts alone: the k-th left document of a range gets the
k-th last free gap above it. So each gap gets at most one document a round, as in one sweep over everything. Gaps are then
made smaller, and the next round begins, until no document is left.
"""

from __future__ import annotations

import math
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlink.llm.common import stored, text_blocks, uniform
from medlink.llm.encode import encoder, tokenizer_path

CAPACITY = 2048
#: Rows of a sorted range, and ranges of a sweep: beyond so many, ranges grow with the table.
RANGE_ROWS, MAX_RANGES = 20_000, 10_000
#: New sequences open for what the open documents need beyond the free room. Once they hold less than the first share of
#: all tokens, only the second share of the room counts: that saves most rounds, which would place a few documents each,
#: for at most their product of all tokens.
LATE = (0.02, 0.9)
#: Pieces up to capacity / SMALL are small. About SINGLES of them a sequence are packed alone, more as bundles of them:
#: so rounds don't grow where all documents are tiny.
SMALL = 16
SINGLES = 4

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None, end_id: int = 0
) -> DataFrame:
    """Pieces of every document: its ids and then ``end_id``, cut after each ``capacity`` ids where it is longer.

    A null text counts as empty: one piece of just the end id. ids_crc32: of the ids as little-endian 32-bit numbers.
    """
    path = path or tokenizer_path()

    def cut(batches):
        coder = encoder(path)
        for batch in batches:
            names, at = batch.column(0).to_pylist(), 0
            for block in text_blocks(batch.column(1)):
                ids, ends = coder.encode(block, end_id)
                ids, rows, low = ids.astype("<u4"), [], 0
                for high in ends.tolist():
                    for piece, start in enumerate(range(low, high, capacity)):
                        part = ids[start : min(start + capacity, high)]
                        rows.append((names[at], piece, start - low, len(part), zlib.crc32(part)))
                    low, at = high, at + 1
                cols, kinds = list(zip(*rows)), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                names_out = ("doc_id", "piece", "start", "length", "ids_crc32")
                yield pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names_out, cols, kinds)})

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        cut, PIECES
    )


def _bundles(pieces: DataFrame, small: int, singles: float) -> DataFrame:
    """Add item: the key of the first piece of a bundle of small pieces, of up to ``small`` tokens; else the piece's own."""
    alone = (F.col("length") > small) | (uniform(F.col("key")) < singles)

    def group(batches):
        item = filled = None
        for batch in batches:
            items = []
            for key, length in zip(batch.column("key").to_pylist(), batch.column("length").to_pylist()):
                if item is None or filled + length > small:
                    item, filled = key, 0
                filled += length
                items.append(item)
            yield pa.RecordBatch.from_pydict({"key": batch.column("key"), "length": batch.column("length"), "item": pa.array(items, pa.int64())})

    rows = pieces.select("key", "length")
    bundled = rows.where(~alone).mapInArrow(group, "key long, length long, item long")
    return rows.where(alone).withColumn("item", F.col("key")).unionByName(bundled)


SWEPT = "kind string, item long, seq long, size long, part int, place long"


def _sweep(batches):
    """Match documents and gaps of one sorted range; rows: is_doc, id, size."""
    part = TaskContext.get().partitionId()
    free: list[tuple[int, int]] = []
    left = 0
    for batch in batches:
        out = []
        for is_doc, name, size in zip(*(batch.column(c).to_pylist() for c in range(3))):
            if not is_doc:
                free.append((name, size))
            elif free:
                seq, gap = free.pop()
                out.append(("match", name, seq, gap - size, part, None))
            else:
                out.append(("doc", name, None, size, part, left))
                left += 1
        yield _swept(out)
    yield _swept([("gap", None, seq, gap, part, place) for place, (seq, gap) in enumerate(free)])


def _swept(rows: list[tuple]) -> pa.RecordBatch:
    names = ("kind", "item", "seq", "size", "part", "place")
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
    cols = list(zip(*rows)) if rows else [()] * 6
    return pa.RecordBatch.from_pydict({n: pa.array(c, k) for n, c, k in zip(names, cols, kinds)})


def match_ranges(left: dict[int, tuple[int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Match what is left of the ranges: left[part] is (documents, gaps).

    Segments (doc_part, first doc, gap_part, first gap, count): documents count upwards, gaps downwards, as the gap
    passed last goes first.
    """
    free: list[list[int]] = []
    out = []
    for part in sorted(left):
        docs, gaps = left[part]
        done = 0
        while done < docs and free:
            gap_part, rest = free[-1]
            count = min(docs - done, rest)
            out.append((part, done, gap_part, rest - 1, count))
            done += count
            free[-1][1] -= count
            if not free[-1][1]:
                free.pop()
        if gaps:
            free.append([part, gaps])
    return out


def best_fit(items: DataFrame, capacity: int = CAPACITY, late: tuple[float, float] = LATE) -> DataFrame:
    """Place items (item: unique long, length: 1 to capacity): rows item, seq, round. seq is its first item's number."""
    if items.where(~F.col("length").between(1, capacity) | F.col("length").isNull()).limit(1).count():
        raise ValueError(f"an item has to hold 1 to {capacity} tokens")
    # two items over half the capacity never share a sequence: each opens its own
    opens = F.col("length") * 2 > capacity
    seed = items.select(
        F.when(opens, "gap").otherwise("doc").alias("kind"),
        "item",
        F.when(opens, F.col("item")).alias("seq"),
        F.when(opens, capacity - F.col("length")).otherwise(F.col("length")).cast("long").alias("size"),
    )
    state, number, everything = stored(seed, "round0"), 0, 0
    placed = [state.where("kind = 'gap'").select("item", "seq", F.lit(0).alias("round"))]
    # two histograms over sizes, of at most capacity rows whatever the data
    sizes = "kind in ('doc', 'gap') and size > 0"
    while True:
        counts = {(r["kind"], r["size"]): r["n"] for r in state.where(sizes).groupBy("kind", "size").agg(F.count(F.lit(1)).alias("n")).collect()}
        docs = {s: n for (k, s), n in counts.items() if k == "doc"}
        if not docs:
            return _union(placed)
        number += 1
        least = min(docs)
        gaps = {s: n for (k, s), n in counts.items() if k == "gap" and s >= least}
        waiting = sum(s * n for s, n in docs.items())
        everything = everything or waiting + sum((capacity - s) * n for (k, s), n in counts.items() if k == "gap")
        need = waiting - (late[1] if waiting < late[0] * everything else 1.0) * sum(s * n for s, n in gaps.items())
        new = max(0, math.ceil(need / capacity))
        if not new and max(docs) > max(gaps, default=0) and least > max(gaps, default=0):
            new = 1
        rows = state.where("kind = 'doc'")
        rows = rows.withColumn("opened", _opened(rows, number, *_largest(docs, new)))
        old = state.where(f"kind = 'gap' and size >= {least}").select(F.lit(False).alias("is_doc"), F.col("seq").alias("id"), "size")
        begun = rows.where("opened").select(F.lit(False).alias("is_doc"), F.col("item").alias("id"), (capacity - F.col("size")).alias("size"))
        wait = rows.where("not opened").select(F.lit(True).alias("is_doc"), F.col("item").alias("id"), "size")
        total = sum(docs.values()) + sum(gaps.values())
        order = [F.desc("size"), F.asc("is_doc"), F.asc("id")]
        swept = stored(
            _ranges(old.unionByName(begun).unionByName(wait), math.ceil(total / max(RANGE_ROWS, total / MAX_RANGES)), order)
            .sortWithinPartitions(*order)
            .mapInArrow(_sweep, SWEPT),
            f"sweep{number}",
        )
        # one row a range
        left = {
            r["part"]: (r["docs"], r["gaps"])
            for r in swept.where("kind <> 'match'")
            .groupBy("part")
            .agg(F.count_if(F.col("kind") == "doc").alias("docs"), F.count_if(F.col("kind") == "gap").alias("gaps"))
            .collect()
        }
        opened_now = rows.where("opened").select(F.lit("open").alias("kind"), "item", F.col("item").alias("seq"), F.lit(None).cast("long").alias("size"))
        state = stored(_settle(swept, match_ranges(left)).unionByName(opened_now), f"round{number}")
        placed.append(state.where("kind = 'open'").select("item", "seq", F.lit(2 * number - 1).alias("round")))
        # a placed item's row also holds the gap behind it
        placed.append(state.where("kind = 'gap' and item is not null").select("item", "seq", F.lit(2 * number).alias("round")))


def _ranges(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """Deal rows into n sorted ranges; what fits one range, at most RANGE_ROWS rows, needs no shuffle."""
    return rows.repartitionByRange(n, *order) if n > 1 else rows.coalesce(1)


def _largest(docs: dict[int, int], wanted: int) -> tuple[int, int, int]:
    """(cut, n, of): the ``wanted`` largest are all above the size cut, and n of the ``of`` documents of that size."""
    for size in sorted(docs, reverse=True) if wanted else ():
        if docs[size] >= wanted:
            return size, wanted, docs[size]
        wanted -= docs[size]
    return (0, 0, 1) if wanted else (max(docs) + 1, 0, 1)


#: So many documents of one size are picked one by one; for more, a hash picks about as many.
PICKED = 200


def _opened(rows: DataFrame, number: int, cut: int, n: int, of: int) -> Column:
    """Whether a document opens a sequence in this round."""
    chance = uniform(F.col("item"), F.lit(number))
    if n <= PICKED:
        equal = rows.where(F.col("size") == cut).select("item").orderBy(chance, "item").limit(n)
        tie = F.col("item").isin([r["item"] for r in equal.collect()])
    else:
        tie = chance < n / of
    return (F.col("size") > cut) | ((F.col("size") == cut) & tie)


def _settle(swept: DataFrame, segments: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """The state after a sweep; segments match what is left of the ranges and are at most two a range."""
    spark = swept.sparkSession
    if not segments:  # nothing to match between ranges
        return swept.select(
            F.when(F.col("kind") == "match", "gap").otherwise(F.col("kind")).alias("kind"), "item", "seq", "size"
        )
    table = spark.createDataFrame(
        [(i, *s) for i, s in enumerate(segments)],
        "segment int, doc_part int, first_doc long, gap_part int, first_gap long, n long",
    )
    doc_side = F.broadcast(table.select("segment", F.col("doc_part").alias("part"), "first_doc", "n"))
    gap_side = F.broadcast(table.select("segment", F.col("gap_part").alias("part"), "first_gap", "n"))
    docs = swept.where("kind = 'doc'")
    docs = docs.join(
        doc_side, (docs["part"] == doc_side["part"]) & docs["place"].between(F.col("first_doc"), F.col("first_doc") + F.col("n") - 1), "left"
    ).select("segment", (F.col("place") - F.col("first_doc")).alias("rank"), F.col("item").alias("doc"), F.col("size").alias("length"))
    gaps = swept.where("kind = 'gap'")
    gaps = gaps.join(
        gap_side, (gaps["part"] == gap_side["part"]) & gaps["place"].between(F.col("first_gap") - F.col("n") + 1, F.col("first_gap")), "left"
    ).select("segment", (F.col("first_gap") - F.col("place")).alias("rank"), F.col("seq").alias("free"), F.col("size").alias("room"))
    matched = docs.where("segment is not null").join(gaps.where("segment is not null"), ["segment", "rank"])
    none = F.lit(None).cast("long")
    return (
        swept.where("kind = 'match'")
        .select(F.lit("gap").alias("kind"), "item", "seq", "size")
        .unionByName(matched.select(F.lit("gap").alias("kind"), F.col("doc").alias("item"), F.col("free").alias("seq"), (F.col("room") - F.col("length")).alias("size")))
        .unionByName(docs.where("segment is null").select(F.lit("doc").alias("kind"), F.col("doc").alias("item"), none.alias("seq"), F.col("length").alias("size")))
        .unionByName(gaps.where("segment is null").select(F.lit("gap").alias("kind"), none.alias("item"), F.col("free").alias("seq"), F.col("room").alias("size")))
    )


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def pack_documents(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, path: str | None = None) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row per piece.

    Repeated rows are packed each for itself; a null text is a piece of one token; an empty table gives no row. Offsets
    of a sequence are gapless from 0.
    """
    pieces = stored(token_pieces(docs, doc_id, text, capacity, path).withColumn("key", F.monotonically_increasing_id()), "pieces")
    small = capacity // SMALL
    tokens, n_small = pieces.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count_if(F.col("length") <= small)).first()
    singles = SINGLES * math.ceil(tokens / capacity) / max(1, n_small)
    bundled = stored(_bundles(pieces, small, singles), "bundles") if singles < 1 else pieces.select("key", "length", F.col("key").alias("item"))
    items = bundled.groupBy("item").agg(F.sum("length").alias("length")) if singles < 1 else bundled.select("item", "length")
    places = best_fit(items, capacity)
    before = Window.partitionBy("seq").orderBy("round", "item", "key").rowsBetween(Window.unboundedPreceding, -1)
    return (
        pieces.join(bundled.select("key", "item"), "key")
        .join(places, "item")
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
    )
