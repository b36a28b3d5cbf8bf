"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

A table hashes a vector to a cell by several functions floor((a . x + b) / width), a normal. A query visits its own cell and
perturbed ones, in order of the squared distances to the cell borders that they cross, which is the order of estimated
success. Candidates of all tables are merged and ranked by exact distance.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlink.llm.common import stored

#: The index is fitted on at most so many vectors, and so many of them as queries; every vector is then indexed.
SAMPLE_VECTORS, SAMPLE_QUERIES = 10_000, 100
#: Recall among the nearest that the sample's queries have to reach.
TARGET_RECALL = 0.97
TABLES = 2
#: Vectors, and queries, of one block of distances.
BLOCK_ROWS = 8192
GROUPS = 12
#: Bound of components and cells of the index, in units of its sample. Squares of numbers below BIG, above its inverse, are safe.
FAR, BIG = 2.0**40, 2.0**400


def unit_of(vectors: np.ndarray) -> float:
    """A power of two near the largest component."""
    top = float(np.abs(vectors).max()) if vectors.size else 0.0
    return float(2.0 ** min(1000, math.frexp(top)[1])) if top else 1.0


def distances(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision; scaled where squares would leave its range."""
    with np.errstate(over="ignore"):
        gap = vectors - query
        out = np.sqrt((gap * gap).sum(axis=1))
    top = np.abs(gap).max(axis=1, initial=0)
    odd = (top > BIG) | ((top < 1 / BIG) & (top > 0))
    if odd.any():
        half = 0.5 * vectors[odd] - 0.5 * query  # a difference of two huge numbers may overflow
        unit = np.ldexp(1.0, np.clip(np.frexp(np.abs(half).max(axis=1))[1], -1020, 1020))
        with np.errstate(over="ignore"):
            out[odd] = 2 * unit * np.sqrt(((half / unit[:, None]) ** 2).sum(axis=1))
    return out


@dataclass
class Index:
    """normals: (tables, functions, dimensions); offsets: (tables, functions); probes: cells visited in each table.

    unit: a power of two that vectors are divided by first, so that nothing overflows.
    """

    normals: np.ndarray
    offsets: np.ndarray
    width: float
    probes: int
    unit: float = 1.0
    sample_recall: float = float("nan")
    sample_visited: float = float("nan")

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Positions in units of cells: (tables, vectors, functions), those far beyond the sample at a bound."""
        near = np.clip(vectors / self.unit, -FAR, FAR)
        return np.clip(np.einsum("tfd,nd->tnf", self.normals, near) / self.width + self.offsets[:, None, :], -FAR, FAR)

    def keys(self, vectors: np.ndarray) -> np.ndarray:
        """The cell of each vector in each table: (tables, vectors)."""
        return _pack(np.floor(self.places(vectors)).astype(np.int64))

    def sequence(self, vectors: np.ndarray, probes: int) -> np.ndarray:
        """The cells that each query visits, best first: (tables, queries, probes)."""
        place = self.places(vectors)
        cell = np.floor(place).astype(np.int64)
        inside = place - cell
        n = cell.shape[2]
        moves = np.stack([c.ravel() for c in np.meshgrid(*[[-1, 0, 1]] * n, indexing="ij")], axis=1)
        # squared distance to the borders crossed by each move
        cost = (inside**2) @ (moves == -1).T.astype(float) + ((1 - inside) ** 2) @ (moves == 1).T.astype(float)
        best = np.argsort(cost, axis=2, kind="stable")[:, :, :probes]
        return _pack(cell[:, :, None, :] + moves[best])


def _pack(cells: np.ndarray) -> np.ndarray:
    """One number per cell, with the table's number on top; coordinates wrap at 256, far beyond where cells are filled."""
    out = np.zeros(cells.shape[:-1], np.int64)
    for k in range(cells.shape[-1]):
        out = out * 256 + (cells[..., k] & 255)
    return out


def fit_index(sample: np.ndarray, k: int = 10, target: float = TARGET_RECALL, seed: int = 1) -> Index:
    """Choose functions a table, cell width and probes: the fewest visited vectors of the sample that reach the target.

    An empty sample gives an index of one cell. Where no choice reaches the target, the one with the best recall is taken.
    """
    rng = np.random.default_rng(seed)
    dim = sample.shape[1] if len(sample) else 1
    if len(sample) < 2:
        return one_cell(dim)
    unit = unit_of(sample)
    sample = sample / unit
    queries = sample[:SAMPLE_QUERIES]
    gaps = np.sqrt(np.maximum(0, (queries**2).sum(1)[:, None] + (sample**2).sum(1)[None] - 2 * queries @ sample.T))
    gaps[np.arange(len(queries)), np.arange(len(queries))] = np.inf
    k = min(k, len(sample) - 1)
    nearest = np.argpartition(gaps, k - 1, axis=1)[:, :k]
    best = None
    for functions in (3, 4, 5, 6):
        normals = rng.normal(size=(TABLES, functions, dim))
        spread = np.std(np.einsum("tfd,nd->tfn", normals, sample)) or 1.0
        for wide in (1.0, 1.5, 2.0):
            index = Index(normals, rng.random((TABLES, functions)), float(wide * spread), 3**functions)
            keys, sequence = index.keys(sample), index.sequence(queries, 3**functions)
            rank = np.full((len(queries), len(sample)), 1 << 30)
            for t in range(TABLES):
                cells, of = np.unique(keys[t], return_inverse=True)
                for q in range(len(queries)):
                    visit = np.full(len(cells), 1 << 30)
                    at = np.searchsorted(cells, sequence[t, q])
                    at[at == len(cells)] = 0
                    found = cells[at] == sequence[t, q]
                    visit[at[found][::-1]] = np.flatnonzero(found)[::-1]
                    rank[q] = np.minimum(rank[q], visit[of])
            hit = np.sort(np.take_along_axis(rank, nearest, axis=1).ravel())
            need = math.ceil(target * len(hit)) - 1
            probes = min(int(hit[need]) + 1, 3**functions)
            recall, visited = float((hit < probes).mean()), float((rank < probes).mean())
            score = (recall < target, -recall if recall < target else visited)
            if best is None or score < best[0]:
                index.probes, index.sample_recall, index.sample_visited = probes, recall, visited
                best = (score, index)
    best[1].unit = unit
    return best[1]


def one_cell(dim: int) -> Index:
    """An index that compares everything."""
    return Index(np.ones((1, 1, dim)), np.full((1, 1), 0.5), 1e300, 1)


def usable(vector: Column) -> Column:
    """Not null, not empty, without null, NaN or infinite components, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _nearest(k: int):
    def search(key: tuple[pa.Scalar, ...], queries: pa.Table, rows: pa.Table) -> pa.Table:
        """The k nearest of a block's vectors, of the cells that each query visits, by exact distance."""
        out = ([], [], [])
        if queries.num_rows and rows.num_rows:
            q, x = _matrix(queries.column("vector")), _matrix(rows.column("vector"))
            ids, names = rows.column("id").to_numpy(), queries.column("query").to_numpy()
            cells, of = np.unique(rows.column("cell").to_numpy(), return_inverse=True)
            visits = queries.column("cells").combine_chunks()
            asked = visits.flatten().to_numpy()
            who = np.repeat(np.arange(len(q)), np.diff(visits.offsets.to_numpy()))
            at = np.minimum(np.searchsorted(cells, asked), len(cells) - 1)
            seen = np.zeros((len(q), len(cells)), bool)
            real = cells[at] == asked
            seen[who[real], at[real]] = True
            unit = max(unit_of(x), unit_of(q))
            scaled = x if 1 / BIG < unit < BIG else x / unit
            norms = (scaled * scaled).sum(axis=1)
            for low in range(0, len(q), 256):
                part = q[low : low + 256] if scaled is x else q[low : low + 256] / unit
                gap = norms[None] - 2 * part @ scaled.T
                gap[~seen[low : low + 256][:, of] | (names[low : low + 256, None] == ids[None])] = np.inf
                slack = 1e-9 * (1 + np.abs(norms).max() + (part * part).sum(axis=1).max())
                kth = np.partition(gap, min(k, gap.shape[1]) - 1, axis=1)[:, min(k, gap.shape[1]) - 1]
                for i, line in enumerate(gap):
                    near = np.flatnonzero((line <= kth[i] + slack) & np.isfinite(line))
                    exact = distances(x[near], q[low + i])
                    order = np.lexsort((ids[near], exact))[:k]
                    out[0].extend([names[low + i]] * len(order))
                    out[1].extend(ids[near[order]].tolist())
                    out[2].extend(exact[order].tolist())
        return pa.table(
            {"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())}
        )

    return search


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    target: float = TARGET_RECALL,
    index: Index | None = None,
) -> DataFrame:
    """The k nearest found of each query among all other rows: query_id, rank, vec_id, score (Euclidean distance).

    is_query tells queries by the column "id", the row's id. Rows whose vector isn't usable and rows with a null id take no
    part. Vectors of different lengths have no distance: each length is searched by itself, with an index of its own. Of
    repeated rows of an id the least vector counts. Ties go to the smaller id. A query that finds fewer than k by its
    probes is compared with everything of its length. Any finite components are taken, also where their squares overflow;
    a distance beyond double precision is infinite.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"))
    rows = rows.where("id is not null").where(usable(F.col("vector"))).groupBy("id").agg(F.min("vector").alias("vector"))
    rows = stored(rows, "vectors")
    lengths = sorted(r["size"] for r in rows.select(F.size("vector").alias("size")).distinct().collect())
    found = None
    for dim in lengths:
        some = _search_length(rows if len(lengths) == 1 else rows.where(F.size("vector") == dim), is_query, k, dim, target, index)
        found = some if found is None else found.unionByName(some)
    return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double") if found is None else found


def _search_length(rows: DataFrame, is_query: Column, k: int, dim: int, target: float, index: Index | None) -> DataFrame:
    """search among stored rows (id, vector) of one length."""
    if index is None:
        head = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_VECTORS).toArrow()
        index = fit_index(np.array(head.column("vector").to_pylist(), np.float64), k, target)
    # of equal vectors, only the k + 1 least ids can be among the k nearest of anything
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = rows.withColumn("place", first).where(F.col("place") <= k + 1).drop("place")
    asked = rows.where(is_query).select(F.col("id").alias("query"), "vector")
    found = _probe(asked, kept, index, k)
    found = stored(_best(found, k), "found")
    complete = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= k)
    poor = stored(asked.join(complete, asked["query"] == complete["query_id"], "left_anti"), "poor")
    rest = _best(_probe(poor, kept, one_cell(dim), k), k)
    return found.join(poor, found["query_id"] == poor["query"], "left_anti").unionByName(rest)


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.dropDuplicates(["query_id", "vec_id"]).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _probe(queries: DataFrame, rows: DataFrame, index: Index, k: int) -> DataFrame:
    """Top candidates of each block of cells that a query visits. Cells are dealt into groups; large groups are split."""

    def grouped(table: np.ndarray, cells: np.ndarray) -> np.ndarray:
        return table * GROUPS + (cells * 0x9E3779B1 >> 16) % GROUPS

    def locate(batches):
        for batch in batches:
            if batch.num_rows:
                keys = index.keys(_matrix(batch.column(1)))
                for t, cells in enumerate(keys):
                    yield pa.RecordBatch.from_pydict({"id": batch.column(0), "vector": batch.column(1), "cell": pa.array(cells), "part": pa.array(grouped(t, cells))})

    def visit(batches):
        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                some = batch.slice(low, 256)
                tables = index.sequence(_matrix(some.column(1)), index.probes)
                for t, cells in enumerate(tables):
                    parts = grouped(t, cells)
                    for part in np.unique(parts):
                        lists = [c[p == part] for c, p in zip(cells, parts)]
                        rows = [i for i, c in enumerate(lists) if len(c)]
                        pick = pa.array(rows, pa.int64())
                        yield pa.RecordBatch.from_pydict(
                            {
                                "query": some.column(0).take(pick),
                                "vector": some.column(1).take(pick),
                                "part": pa.array([int(part)] * len(rows), pa.int64()),
                                "cells": pa.array([lists[i] for i in rows], pa.list_(pa.int64())),
                            }
                        )

    placed = rows.select("id", "vector").mapInArrow(locate, "id long, vector array<double>, cell long, part long")
    asked = queries.select("query", "vector").mapInArrow(visit, "query long, vector array<double>, part long, cells array<long>")
    # at most one row a group and side; how many blocks each is cut into
    blocks = F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int")
    row_blocks = placed.groupBy("part").agg(blocks.alias("row_blocks"))
    query_blocks = asked.groupBy("part").agg(blocks.alias("query_blocks"))
    sizes = row_blocks.join(query_blocks, "part")

    def steps(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    placed = placed.join(F.broadcast(sizes), "part").select(
        "part", F.pmod(F.xxhash64("id"), F.col("row_blocks")).cast("int").alias("r"), steps("query_blocks").alias("q"), "id", "vector", "cell"
    )
    asked = asked.join(F.broadcast(sizes), "part").select(
        "part", steps("row_blocks").alias("r"), F.pmod(F.xxhash64("query"), F.col("query_blocks")).cast("int").alias("q"), "query", "vector", "cells"
    )
    by = ["part", "r", "q"]
    return asked.groupBy(*by).cogroup(placed.groupBy(*by)).applyInArrow(_nearest(k), "query_id long, vec_id long, score double")
