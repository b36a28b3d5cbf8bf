"""Dimension-sharded Lloyd clustering over integer vectors, exact at every step.

Vectors are cut into column blocks, each block a shard with its own files and its own slice of the centroids. A round:

1. A block's tasks compute the squared distances of its columns to the centroids' slices: partial sums, exact integers.
2. The partial sums of a row chunk meet under its key and are added; the least total names each vector's centroid.
3. The assignments go back to the blocks, and each shard replaces its own slice by the floors of its means.

A chunk has a bounded number of vectors, so partial sums and assignments travel as whole small matrices. Centroids are
k x dimensions numbers whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.llm.common import stored

#: Columns of a block, vectors of a chunk.
BLOCK_DIMS, CHUNK_ROWS = 16, 2048
#: Components are integers of a smaller magnitude, so that a squared distance over 64 of them is a long.
LIMIT = 1 << 27

CHUNK = "block int, chunk long, rows int, data binary"
SLICE = "block int, cluster int, dim int, value long"


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector.cast("array<double>"), lambda x: F.floor(x * F.lit(float(scale))))


def whole(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    bad = F.exists(vector.cast("array<double>"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def column_blocks(vectors: DataFrame, dims: int, block_dims: int) -> DataFrame:
    """Chunks of rows cut into column blocks: (block, chunk, rows, data: int32 matrix); block -1 holds the rows' ids (int64).

    vectors: id long, vector array<long>. A null id is kept as a mask behind the ids.
    """

    def cut(batches):
        chunk = TaskContext.get().partitionId() << 33
        for batch in batches:
            for low in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(low, CHUNK_ROWS)
                ids, n = part.column(0), part.num_rows
                matrix = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(n, dims).astype("<i4")
                known = np.asarray(ids.is_valid())
                names = np.asarray(ids.fill_null(0)).astype("<i8").tobytes() + known.astype(np.uint8).tobytes()
                data = [names, *(np.ascontiguousarray(matrix[:, at : at + block_dims]).tobytes() for at in range(0, dims, block_dims))]
                blocks = list(range(-1, len(data) - 1))
                yield _batch(CHUNK, blocks, [chunk] * len(data), [n] * len(data), data)
                chunk += 1

    return vectors.mapInArrow(cut, CHUNK)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _batch(schema: str, *columns) -> pa.RecordBatch:
    names, kinds = zip(*(part.split(" ") for part in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names=names)


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows one by one: each is a whole matrix."""
    for batch in batches:
        for at in range(batch.num_rows):
            yield tuple(batch.column(n)[at].as_py() for n in names)


def _slices(centroids: DataFrame) -> DataFrame:
    """One row a block: its slice of all centroids in order of cluster and column."""
    ordered = F.array_sort(F.collect_list(F.struct("cluster", "dim", "value")))
    return centroids.groupBy("block").agg(F.max("cluster").alias("last"), F.transform(ordered, lambda x: x["value"]).alias("slice"))


def partial_distances(blocks: DataFrame, centroids: DataFrame) -> DataFrame:
    """Of each block of a chunk, the squared distances of its columns to all centroids: an integer matrix rows x k."""

    def distances(batches):
        for block, chunk, rows, data, last, values in _rows(batches, "block", "chunk", "rows", "data", "last", "slice"):
            x = np.frombuffer(data, "<i4").reshape(rows, -1).astype(np.int64)
            centres = np.array(values, np.int64).reshape(last + 1, -1)
            # exact in 64-bit integers: no matrix product in floating point
            out = np.zeros((rows, last + 1), np.int64)
            for d in range(x.shape[1]):
                gap = x[:, d, None] - centres[None, :, d]
                out += gap * gap
            small = bool(out.max() < 1 << 31)  # half the bytes for the shuffle
            yield _batch(CHUNK, [block], [chunk], [rows], [(b"4" if small else b"8") + out.astype("<i4" if small else "<i8").tobytes()])

    # a row a block, k x block_dims numbers each
    return blocks.join(F.broadcast(_slices(centroids)), "block").mapInArrow(distances, CHUNK)


ASSIGNED = "chunk long, rows int, clusters binary, distances binary"


def _added(emit: Callable) -> Callable:
    """Add the partial sums of each chunk (rows come sorted by chunk, then block) and hand on (chunk, ids, totals)."""

    def run(batches):
        current, names, total = None, None, None
        for chunk, block, rows, data in _rows(batches, "chunk", "block", "rows", "data"):
            if chunk != current:
                if total is not None:
                    yield emit(current, names, total)
                current, names, total = chunk, None, None
            if block < 0:
                names = data
                continue
            part = np.frombuffer(data, "<i4" if data[:1] == b"4" else "<i8", offset=1).reshape(rows, -1)
            total = part.astype(np.int64) if total is None else total + part
        if total is not None:
            yield emit(current, names, total)

    return run


def _emit_assigned(chunk: int, names: bytes | None, total: np.ndarray) -> pa.RecordBatch:
    best = total.argmin(axis=1)  # the first of equal ones: the smaller number
    return _batch("chunk long, clusters binary", [chunk], [best.astype("<i4").tobytes()])


MEMBER = "vec_id long, cluster int, distance long"


def _emit_members(chunk: int, names: bytes | None, total: np.ndarray) -> pa.RecordBatch:
    best, n = total.argmin(axis=1), len(total)
    ids, known = np.frombuffer(names, "<i8", n), np.frombuffer(names, np.uint8, n, offset=8 * n).astype(bool)
    return _batch(MEMBER, pa.array(ids, mask=~known), best, total[np.arange(n), best])


def _by_chunk(partials: DataFrame) -> DataFrame:
    return partials.repartition("chunk").sortWithinPartitions("chunk", "block")


def assign(blocks: DataFrame, centroids: DataFrame) -> DataFrame:
    """(chunk, clusters: int32 of each of its rows)."""
    return _by_chunk(partial_distances(blocks, centroids)).mapInArrow(_added(_emit_assigned), "chunk long, clusters binary")


def assign_members(blocks: DataFrame, ids: DataFrame, centroids: DataFrame) -> DataFrame:
    """(vec_id, cluster, distance), one row a vector."""
    both = partial_distances(blocks, centroids).unionByName(ids.select("block", "chunk", "rows", "data"))
    return _by_chunk(both).mapInArrow(_added(_emit_members), MEMBER)


def update(blocks: DataFrame, assigned: DataFrame, centroids: DataFrame) -> DataFrame:
    """Each shard's new slice: floors of the means of its columns; an empty cluster keeps its centroid."""
    sums = "block int, cluster int, dim int, total long, n long"

    def add(batches):
        totals: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for block, rows, data, clusters in _rows(batches, "block", "rows", "data", "clusters"):
            x, of = np.frombuffer(data, "<i4").reshape(rows, -1), np.frombuffer(clusters, "<i4")
            old, count = totals.get(block, (np.zeros((0, x.shape[1]), np.int64), np.zeros(0, np.int64)))
            k = max(len(count), int(of.max()) + 1)
            new, n = np.zeros((k, x.shape[1]), np.int64), np.bincount(of, minlength=k)
            new[: len(old)], n[: len(count)] = old, n[: len(count)] + count
            np.add.at(new, of, x)
            totals[block] = new, n
        for block, (total, n) in totals.items():
            k, dims = total.shape
            yield _batch(sums, [block] * (k * dims), np.repeat(np.arange(k), dims), np.tile(np.arange(dims), k), total.ravel(), np.repeat(n, dims))

    parts = blocks.join(assigned, "chunk").mapInArrow(add, sums)
    # a row a task, block, cluster and column at most; decimals hold any sum of longs
    total, n = F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").cast("decimal(38,0)").alias("n")
    means = parts.groupBy("block", "cluster", "dim").agg(total, n).where("n > 0")
    means = means.select("block", "cluster", "dim", F.expr("cast((total - pmod(total, n)) div n as long)").alias("mean"))
    return centroids.join(means, ["block", "cluster", "dim"], "left").select(
        "block", "cluster", "dim", F.coalesce("mean", "value").alias("value")
    )


def first_centroids(vectors: DataFrame, k: int, seed: int, block_dims: int) -> DataFrame:
    """The vectors with the smallest SHA-256 of ``seed:id``, numbered in that order and cut into slices."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    chosen = vectors.select(F.struct(order, "vector").alias("_order"), "vector").orderBy("_order").limit(k)
    # k rows
    numbered = chosen.agg(F.array_sort(F.collect_list("_order")).alias("all")).select(F.posexplode("all").alias("cluster", "row"))
    values = numbered.select("cluster", F.posexplode(F.col("row.vector")).alias("at", "value"))
    return values.select((F.col("at") / block_dims).cast("int").alias("block"), "cluster", (F.col("at") % block_dims).alias("dim"), "value")


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: int = 256,
    seed: int = 2,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block_dims: int = BLOCK_DIMS,
) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256.

    Kept are vectors of exactly ``dims`` components, none null or non-finite; each component x becomes floor(scale * x).
    Repeated rows count each for itself, a null vec_id is kept and hashed as an empty one; equal vectors that tie for a
    first centroid are alike anyway. With fewer than k kept vectors each begins one centroid. An empty table gives no row;
    other columns don't matter. An integer component of LIMIT or more in magnitude raises, as its distance needn't be a long.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("vector")).where(whole(F.col("vector"), dims))
    rows = rows.select("id", scaled(F.col("vector"), scale).alias("vector"))
    far = F.exists("vector", lambda x: F.abs(x) >= LIMIT)
    checked = F.when(far, F.raise_error(F.lit(f"an integer component has a magnitude of {LIMIT} or more"))).otherwise(F.col("vector"))
    rows = rows.select("id", checked.cast("array<long>").alias("vector"))
    cut = stored(column_blocks(rows, dims, block_dims), "blocks", by="block")
    ids, blocks = cut.where("block < 0"), cut.where("block >= 0")
    centroids = stored(first_centroids(rows, k, seed, block_dims), "centroids")
    for _ in range(rounds):
        assigned = stored(assign(blocks, centroids), "assigned")
        centroids = stored(update(blocks, assigned, centroids), "centroids")
    members = stored(assign_members(blocks, ids, centroids), "members")
    number = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "dim", "value"))), lambda x: x["value"].cast("string")), ",")
    shas = centroids.groupBy("cluster").agg(F.sha2(number, 256).alias("centroid_sha256"))
    sums = members.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    sums = sums.join(shas, "cluster")
    # at most k rows
    whole_sum = sums.agg(F.sum("cluster_inertia")).first()[0]
    return members.join(F.broadcast(sums), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", F.lit(whole_sum).cast("long").alias("inertia"), "centroid_sha256"
    )
