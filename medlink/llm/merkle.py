"""Merkle manifest of a dataset: a persistent hash tree over aligned blocks, with one version for each tampered leaf.

Leaves are numbered within their tree, and every 2 ** BLOCK_BITS consecutive ones are an aligned block: a block's own
levels need nothing outside it, and its root is a leaf of the next tier, whose blocks are aligned again. Tier after tier
the number of nodes falls by a factor of 1024; no task holds more than a block.

Versions are made by path copying. A changed leaf copies only its ancestors: first those inside its block, then those
above it, along a path of untouched siblings that all leaves of the block share. So versions continue upwards side by
side, each in the task of its lowest block, and no block near the root ever gathers the versions that pass through it.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlink.llm.common import stored

#: An aligned block has 2 ** BLOCK_BITS nodes.
BLOCK_BITS = 10
#: Rows of a range of the sort that numbers leaves: the number of ranges grows with the table.
RANGE_ROWS = 200_000
#: The tree of all subroots.
FOREST = "forest"

NODE = "tree string, idx long, n long, digest string"
PATH = "tree string, idx long, path array<string>, subroot string"


def field(value: Column) -> Column:
    """A field's part of a leaf's input: ``-`` for null, else its UTF-8 length, a colon, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*values: Column) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def digest_of(*parts: str) -> str:
    """The parent of nodes given as hexadecimal digests."""
    return sha256("".join(parts).encode()).hexdigest()


def block_levels(digests: list[str], height: int) -> list[list[str]]:
    """All levels of a block from its nodes up, ``height`` above them; a last run may be one node."""
    levels = [digests]
    for _ in range(height):
        low = levels[-1]
        levels.append([digest_of(*low[i : i + 2]) for i in range(0, len(low), 2)])
    return levels


def path_in_block(levels: list[list[str]], at: int) -> list[str]:
    """Siblings of node ``at`` level by level: L or R (the side they are on) and the digest, or - where there is none."""
    out = []
    for level in levels[:-1]:
        other = at ^ 1
        out.append("-" if other >= len(level) else ("L" if other < at else "R") + level[other])
        at >>= 1
    return out


def copied_path(digest: str, path: list[str]) -> list[str]:
    """The ancestors that a version copies for a changed node: its parent first, the root last."""
    out = []
    for step in path:
        if step == "-":
            digest = digest_of(digest)
        else:
            digest = digest_of(step[1:], digest) if step[0] == "L" else digest_of(digest, step[1:])
        out.append(digest)
    return out


def height_of(n: int, bits: int) -> int:
    """Levels above the nodes of a block, in a tier of n nodes: all up to the root if one block holds the tier."""
    return min(bits, (n - 1).bit_length())


def numbered(rows: DataFrame, tree: str, order: list[Column]) -> DataFrame:
    """Add idx, the place from 0 within each tree along ``order``, and n, the tree's rows.

    Ranges are sorted over the cluster and numbered each for itself; what lies before a range of a tree comes from counts,
    one row a tree and range. Rows equal in ``order`` are split over ranges by a hash of their place in the input.
    """
    total = rows.count()
    ranges = max(1, -(-total // RANGE_ROWS))
    sort = [F.col(tree), *order, F.xxhash64(F.col("_at"))]

    def number(batches):
        current, place = None, 0
        for batch in batches:
            places = []
            for name in batch.column("_tree").to_pylist():
                if name != current:
                    current, place = name, 0
                places.append(place)
                place += 1
            names = [*batch.schema.names, "_place"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], names=names)

    placed = rows.withColumns({"_at": F.monotonically_increasing_id(), "_tree": F.col(tree)})
    placed = placed.repartitionByRange(ranges, *sort).sortWithinPartitions(*sort).withColumn("_range", F.spark_partition_id())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in placed.schema) + ", _place long"
    placed = stored(placed.mapInArrow(number, schema), "numbered")
    counts = placed.groupBy("_tree", "_range").agg(F.count(F.lit(1)).alias("_rows"))
    by_tree = Window.partitionBy("_tree")
    before = by_tree.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(
        "_tree", "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"), F.sum("_rows").over(by_tree).alias("n")
    )
    return placed.join(starts, ["_tree", "_range"]).withColumn("idx", F.col("_place") + F.col("_before")).drop("_at", "_tree", "_range", "_place", "_before")


@dataclass
class Tree:
    """tiers[0]: the nodes given; tiers[t]: roots of the blocks of the tier before (tree, idx, n, digest).

    roots: the last node of each tree (tree, digest).
    """

    tiers: list[DataFrame]
    roots: DataFrame
    bits: int


def _block(bits: int) -> Column:
    return F.shiftright("idx", bits).alias("block")


def _in_order(table: pa.Table) -> pa.Table:
    return table.take(pc.sort_indices(table, sort_keys=[("idx", "ascending")]))


def build(nodes: DataFrame, bits: int = BLOCK_BITS) -> Tree:
    """The base version over numbered nodes (tree, idx, n, digest), tier by tier, each tier a stored table."""

    def root(table: pa.Table) -> pa.Table:
        table = _in_order(table)
        n = table.column("n")[0].as_py()
        top = block_levels(table.column("digest").to_pylist(), height_of(n, bits))[-1]
        out = [table.column("tree")[0].as_py()], [table.column("idx")[0].as_py() >> bits], [-(-n >> bits)], top
        return pa.table({name: pa.array(c, t) for name, c, t in zip(("tree", "idx", "n", "digest"), out, _NODE_TYPES)})

    tiers, roots = [nodes], None
    while True:
        open_nodes = tiers[-1] if len(tiers) == 1 else tiers[-1].where("n > 1")
        above = stored(open_nodes.select("tree", "idx", "n", "digest", _block(bits)).groupBy("tree", "block").applyInArrow(root, NODE), "tier")
        done = above.where("n = 1").select("tree", "digest")
        roots = done if roots is None else roots.unionByName(done)
        tiers.append(above)
        if not above.where("n > 1").limit(1).count():
            return Tree(tiers, roots, bits)


_NODE_TYPES = (pa.string(), pa.int64(), pa.int64(), pa.string())
_PATH_TYPES = (pa.string(), pa.int64(), pa.list_(pa.string()), pa.string())
_PATH_NAMES = ("tree", "idx", "path", "subroot")


def paths_above(tree: Tree, root_paths: DataFrame) -> DataFrame:
    """Siblings of every block of the lowest tier, from the block's root up to the root of all: (tree, idx, path, subroot).

    root_paths (tree, path, subroot): what lies above each tree's root, and that root. Paths go down the tiers: a node's is
    what its own block adds, followed by its block's path, so a block's path meets at most a block of nodes.
    """
    bits = tree.bits

    def extend(key: tuple, nodes: pa.Table, above: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return pa.table({n: pa.array([], t) for n, t in zip(_PATH_NAMES, _PATH_TYPES)})
        nodes = _in_order(nodes)
        levels = block_levels(nodes.column("digest").to_pylist(), height_of(nodes.column("n")[0].as_py(), bits))
        rest = above.column("path")[0].as_py() if above.num_rows else []
        paths = [path_in_block(levels, i) + rest for i in range(nodes.num_rows)]
        top = above.column("subroot")[0].as_py() if above.num_rows else None
        cols = nodes.column("tree").to_pylist(), nodes.column("idx").to_pylist(), paths, [top] * len(paths)
        return pa.table({n: pa.array(c, t) for n, c, t in zip(_PATH_NAMES, cols, _PATH_TYPES)})

    known = None
    for tier in reversed(tree.tiers[1:]):
        done = tier.where("n = 1").join(root_paths, "tree").select(*_PATH_NAMES)
        if known is not None:
            lower = tier.where("n > 1").select("tree", "idx", "n", "digest", _block(bits))
            upper = known.select("tree", F.col("idx").alias("block"), "path", "subroot")
            grown = lower.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(extend, PATH)
            done = done.unionByName(grown)
        known = stored(done, "paths")
    return known


def versions(leaves: DataFrame, above: DataFrame, bits: int = BLOCK_BITS) -> DataFrame:
    """Proof of every leaf, and the version that each changed leaf makes.

    leaves (tree, idx, n, digest, changed: a changed leaf's digest or null, and any others); above (tree, idx, path,
    subroot) of their blocks. Adds path (siblings up to the root of all), subroot, and copied: the version's new nodes from the changed leaf's
    parent to its root, null where nothing is changed. All other nodes of a version are those of the base version.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in leaves.schema) + ", path array<string>, subroot string, copied array<string>"

    def copy(key: tuple, rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        rest = upper.column("path")[0].as_py() if upper.num_rows else []
        n = rows.column("n")[0].as_py() if rows.num_rows else 1
        levels = block_levels(rows.column("digest").to_pylist(), height_of(n, bits))
        paths = [path_in_block(levels, i) + rest for i in range(rows.num_rows)]
        copied = [None if c is None else copied_path(c, p) for c, p in zip(rows.column("changed").to_pylist(), paths)]
        top = upper.column("subroot")[0].as_py() if upper.num_rows else None
        kind = pa.list_(pa.string())
        out = rows.drop_columns(["block"]).append_column("path", pa.array(paths, kind))
        return out.append_column("subroot", pa.array([top] * len(paths), pa.string())).append_column("copied", pa.array(copied, kind))

    by = ["tree", "block"]
    blocks = leaves.withColumn("block", F.shiftright("idx", bits))
    upper = above.select("tree", F.col("idx").alias("block"), "path", "subroot")
    return blocks.groupBy(*by).cogroup(upper.groupBy(*by)).applyInArrow(copy, schema)


def manifest(docs: DataFrame, leaf: list[str] | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """The manifest of documents, a tree for each language, checked against tampering.

    Rows: doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified, and for each version (tampered leaf) its
    tampered_leaf and copied, the nodes it adds. Where 7 divides the CRC-32 of the decimal doc_id, 1 is added to n_chars;
    a null n_chars stays, so such a version equals the base version. Any field may be null (a null lang is a tree of its own,
    before the others; a row without doc_id is never tampered with and comes first). Rows that repeat a doc_id in a
    language are ordered by their leaf. An empty table gives no row; other columns don't matter.
    """
    doc_id, source, lang, n_chars, text = (F.col(c) for c in leaf or ["doc_id", "source", "lang", "n_chars", "text"])
    hit = F.coalesce(F.crc32(doc_id.cast("string")) % 7 == 0, F.lit(False))
    rows = docs.select(
        doc_id.cast("long").alias("doc_id"),
        lang.cast("string").alias("lang"),
        # sorts as languages do, with null first
        F.coalesce(F.concat(F.lit("l"), lang.cast("string")), F.lit("")).alias("tree"),
        leaf_digest(doc_id, source, lang, n_chars, text).alias("digest"),
        F.when(hit, leaf_digest(doc_id, source, lang, n_chars + F.lit(1).cast("long"), text)).alias("changed"),
    )
    rows = stored(rows, "digests")  # texts are read once
    leaves = stored(numbered(rows, "tree", [F.col("doc_id"), F.col("digest")]), "leaves")
    tree = build(leaves, bits)
    subroots = tree.roots.select(F.lit(FOREST).alias("all"), F.col("tree").alias("name"), "digest")
    subroots = stored(numbered(subroots, "all", [F.col("name")]).withColumnRenamed("all", "tree"), "subroots")
    forest = build(subroots, bits)
    top = forest.roots.first()  # one row
    root = F.lit(top["digest"] if top else None).cast("string")
    nothing = forest.roots.select("tree", F.array().cast("array<string>").alias("path"), root.alias("subroot"))
    named = versions(subroots.withColumn("changed", F.lit(None).cast("string")), paths_above(forest, nothing), bits)
    root_paths = stored(named.select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot")), "root_paths")
    siblings = F.filter("path", lambda s: s != "-")
    proof = F.sha2(F.array_join(F.transform(siblings, lambda s: F.substring(s, 2, 64)), ""), 256)
    folded = F.when(F.col("changed").isNull(), root).otherwise(F.coalesce(F.try_element_at("copied", F.lit(-1)), "changed"))
    return (
        versions(leaves, paths_above(tree, root_paths), bits)
        .select("doc_id", "lang", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof.alias("proof_sha256"), folded.alias("folded_root"), F.col("changed").alias("tampered_leaf"), "copied")
        .withColumn("verified", F.col("folded_root") == F.col("root"))
    )
