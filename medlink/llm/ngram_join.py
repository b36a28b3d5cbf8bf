"""Similarity join of texts on word n-grams: MinHash bands find candidates, full n-gram sets decide.

Texts with equal n-gram sets are one class from the start. Representatives of classes that share a band hash with another
class are grouped into components of the band graph; each component is compared within itself, all against all, in square
blocks of bounded size. Only counts and one link per class and block leave a block, never its pairs.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlink.llm.common import stored, text_blocks
from medlink.llm.ngrams import gram_sets, mix

NGRAM = 5
SIMILARITY = 0.8
#: A pair just as similar as asked becomes a candidate with this probability, more similar ones more surely.
RECALL = 0.9999
MAX_HASHES = 128
#: Classes, and n-grams, of one side of a block of comparisons.
BLOCK_CLASSES = 512
BLOCK_GRAMS = 1_000_000


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band, so the fewest false candidates, that reach the recall with so many hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("the recall can't be reached with so few hashes")
    return best


def band_hashes(sets: list[np.ndarray], bands: int, rows: int, seed: int = 1) -> np.ndarray:
    """Band hashes of non-empty sets, one row a set."""
    flat = np.concatenate(sets)
    start = np.r_[0, np.cumsum([len(s) for s in sets])[:-1]]
    salts = mix(np.arange(1, 2 * bands * rows + 1, dtype=np.uint64) + np.uint64(seed << 32))
    out = np.zeros((len(sets), bands), np.uint64)
    for band in range(bands):
        folded = np.full(len(sets), np.uint64(band + 1))
        for k in range(band * rows, (band + 1) * rows):
            least = np.minimum.reduceat(flat * (salts[2 * k] | np.uint64(1)) + salts[2 * k + 1], start)
            folded = mix(folded + least)
        out[:, band] = folded
    return out.view(np.int64)


def _key(grams: np.ndarray) -> bytes:
    return hashlib.blake2b(grams.tobytes(), digest_size=16).digest()


def signatures(docs: DataFrame, doc_id: str, text: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, mark (a hash of the text), key (of the n-gram set; null without one), n_grams and bands of each document."""

    def sign(batches):
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column(1)):
                sets = gram_sets(block, n)
                full = [i for i, s in enumerate(sets) if len(s)]
                hashes = band_hashes([sets[i] for i in full], bands, rows).tolist() if full else []
                lists: list[list[int] | None] = [None] * len(sets)
                for i, values in zip(full, hashes):
                    lists[i] = values
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).slice(at, len(block)),
                        "mark": batch.column(2).slice(at, len(block)),
                        "key": pa.array([_key(s) if len(s) else None for s in sets], pa.binary()),
                        "n_grams": pa.array([len(s) for s in sets], pa.int64()),
                        "bands": pa.array(lists, pa.list_(pa.int64())),
                    }
                )
                at += len(block)

    return marked(docs, doc_id, text).select("doc_id", "text", "mark").mapInArrow(
        sign, "doc_id long, mark long, key binary, n_grams long, bands array<long>"
    )


def marked(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text and mark: id and mark tell rows of different texts apart, also where they share an id."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("mark", F.xxhash64("text"))


def components(members: DataFrame, name: str) -> DataFrame:
    """Connected components of a bipartite graph: members(key, rep, bucket) to (key, label), label the least rep.

    Every key has a rep of its own, a struct of its least doc_id and itself, so keys that share a doc_id stay apart.

    Each round takes the least label over each bucket, over each key, and then the label's own label, so the distance
    covered about doubles; it ends when no label changes. All steps are aggregates with map-side combination.
    """
    edges = stored(members.select("key", "bucket"), f"{name}-edges")
    labels = stored(members.groupBy("key").agg(F.min("rep").alias("rep")).withColumn("label", F.col("rep")), f"{name}-labels")
    while True:
        buckets = edges.join(labels, "key").groupBy("bucket").agg(F.min("label").alias("label"))
        least = edges.join(buckets, "bucket").groupBy("key").agg(F.min("label").alias("new"))
        moved = labels.join(least, "key").select("key", "rep", F.col("label").alias("old"), "new")
        jump = moved.groupBy(F.col("rep").alias("at")).agg(F.min("new").alias("further"))
        labels = stored(
            moved.join(jump, moved["new"] == jump["at"], "left").select(
                "key", "rep", F.least("new", F.coalesce("further", "new")).alias("label"), "old"
            ),
            f"{name}-labels",
        )
        if labels.where("label <> old").limit(1).count() == 0:
            return labels.select("key", "label")
        labels = labels.drop("old")


def linked(sets: list[np.ndarray], other: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Boolean matrix of the pairs whose Jaccard similarity is at least ``similarity``; other: None compares within."""
    both = sets + (other or [])
    flat = np.concatenate(both)
    owner = np.repeat(np.arange(len(both)), [len(s) for s in both])
    _, gram, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1
    keep = shared[gram]
    column = (np.cumsum(shared) - 1)[gram[keep]]
    owner = owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    n_left, width = len(sets), 4096
    common = np.zeros((n_left, len(both) if other is None else len(other)), np.float32)
    ends = np.searchsorted(column, np.arange(0, shared.sum() + width, width))
    for low, high, first in zip(ends[:-1], ends[1:], range(0, shared.sum() + width, width)):
        grid = np.zeros((len(both), width), np.float32)
        grid[owner[low:high], column[low:high] - first] = 1
        common += grid[:n_left] @ (grid if other is None else grid[n_left:]).T
    size = np.array([len(s) for s in both], np.float64)
    right = size if other is None else size[n_left:]
    return common >= similarity * (size[:n_left, None] + right[None, :] - common) - 1e-9


VERIFIED = "key binary, links long, root binary"


def _verify(similarity: float):
    """Compare a block: rows of one side, or of two. Returns each class's number of linked documents and a linked root."""

    def compare(key, tab: pa.Table) -> pa.Table:
        names = tab.column("key").to_pylist()
        tab = tab.take(pa.array(list({k: i for i, k in enumerate(names)}.values()), pa.int64()))
        side = tab.column("block").to_numpy()
        order = np.argsort(side, kind="stable")
        tab, side = tab.take(pa.array(order)), side[order]
        sets = [np.frombuffer(b, np.uint64) for b in tab.column("grams").to_pylist()]
        docs = tab.column("n_docs").to_numpy()
        n_left = int((side == side[0]).sum()) if len(side) else 0
        if key[1].as_py() != key[2].as_py():
            hit = linked(sets[:n_left], sets[n_left:], similarity) if 0 < n_left < len(sets) else np.zeros((n_left, len(sets) - n_left), bool)
            links = np.r_[hit @ docs[n_left:], hit.T @ docs[:n_left]]
            left, right = np.nonzero(hit)
            right = right + n_left
        else:
            hit = linked(sets, None, similarity)
            np.fill_diagonal(hit, False)
            links = hit @ docs
            left, right = np.nonzero(hit)
        root = np.arange(len(sets))
        while len(left):  # the least number spreads along the links
            new = root.copy()
            np.minimum.at(new, left, root[right])
            np.minimum.at(new, right, root[left])
            new = np.minimum(new, new[new])
            if (new == root).all():
                break
            root = new
        return pa.table(
            {
                "key": tab.column("key"),
                "links": pa.array(links.astype(np.int64)),
                "root": tab.column("key").take(pa.array(root)),
            }
        )

    return compare


def near_copies(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    n: int = NGRAM,
    similarity: float = SIMILARITY,
    recall: float = RECALL,
) -> DataFrame:
    """One row per document: doc_id, class_id and n_links.

    n_links: other documents whose n-gram sets have a Jaccard similarity of ``similarity`` or more. class_id: the least
    doc_id of all documents reached over such links. A text without words links to nothing and is its own class, as is a
    row with a null doc_id, whose class is null. Repeated rows, and rows of different texts that share a doc_id, count as
    documents of their own. Pairs of equal sets are always found; others with a probability of at least ``recall``.
    """
    rows = linked_rows(docs, doc_id, text, n, similarity, recall)
    return rows.select("doc_id", F.col("class.doc_id").alias("class_id"), "n_links")


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """(doc_id, mark, see marked) of the row that stays of each class; rows with a null doc_id have none.

    It is the row with the least id, and of several texts with that id one.
    """
    rows = linked_rows(docs, doc_id, text, **options).where("doc_id is not null")
    own = F.when(F.col("class.key").isNull(), F.col("mark"))  # a text without words is its own class
    return rows.groupBy("class", own).agg(F.min(F.struct("doc_id", "mark")).alias("least")).select("least.*").distinct()


def linked_rows(docs: DataFrame, doc_id: str, text: str, n: int = NGRAM, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """doc_id, mark, class (a struct that names the class; its doc_id is the least) and n_links of every row."""
    bands, rows = choose_bands(similarity, recall)
    signed = stored(signatures(docs, doc_id, text, n, bands, rows), "signatures")
    first = F.min(F.struct("doc_id", "mark")).alias("first")
    classes = stored(
        signed.where("key is not null and doc_id is not null")
        .groupBy("key")
        .agg(first, F.count(F.lit(1)).alias("n_docs"), F.max("n_grams").alias("n_grams"), F.first("bands").alias("bands"))
        .withColumn("rep", F.struct(F.col("first.doc_id"), "key")),
        "classes",
    )
    exploded = classes.select("key", "rep", F.explode("bands").alias("bucket"))
    shared = exploded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("bucket")
    candidates = components(exploded.join(shared, "bucket"), "bands")
    verified = stored(_compare(docs, classes, candidates, doc_id, text, n, similarity), "verified")
    links = verified.groupBy("key").agg(F.sum("links").alias("links"))
    reached = verified.where("links > 0").select("key", F.concat_ws("/", "label", "i", "j", F.hex("root")).alias("bucket"))
    spread = components(reached.join(classes.select("key", "rep"), "key"), "links")
    # written, so that the join below has plain shuffles on both sides and a hot class is split like any skewed key
    found = stored(
        classes.select("key", "rep", "n_docs")
        .join(links, "key", "left")
        .join(spread, "key", "left")
        .select(
            "key",
            F.coalesce("label", "rep").alias("class"),
            (F.col("n_docs") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        ),
        "found",
    )
    alone = F.struct("doc_id", F.lit(None).cast("binary").alias("key"))
    none = F.lit(0).cast("long").alias("n_links")
    wordless = signed.where("key is null or doc_id is null").select("doc_id", "mark", alone.alias("class"), none)
    out = signed.where("doc_id is not null and key is not null").select("doc_id", "mark", "key").join(found, "key")
    return out.select("doc_id", "mark", "class", F.col("n_links").cast("long").alias("n_links")).unionByName(wordless)


def _compare(docs, classes, candidates, doc_id, text, n, similarity) -> DataFrame:
    """Candidates' n-gram sets, read from their texts again, compared by blocks of their components."""
    candidates = candidates.select("key", F.hex("label.key").alias("label"))
    sizes = (
        candidates.join(classes, "key")
        .groupBy("label")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("n_grams").alias("grams"))
        .where("n > 1")
        .select("label", F.ceil(F.greatest(F.col("n") / BLOCK_CLASSES, F.col("grams") / BLOCK_GRAMS)).cast("int").alias("blocks"))
    )
    wanted = candidates.join(sizes, "label").join(classes.select("key", "first.*", "n_docs"), "key")

    def ngrams(batches):
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column("text")):
                sets = gram_sets(block, n)
                part = batch.slice(at, len(block))
                at += len(block)
                cols = {c: part.column(c) for c in ("key", "n_docs", "label", "blocks")}
                yield pa.RecordBatch.from_pydict(cols | {"grams": pa.array([s.tobytes() for s in sets], pa.binary())})

    # one row a text and id: of wholly repeated rows, which may be most of a table, one leaves each task
    texts = marked(docs, doc_id, text).groupBy("doc_id", "mark").agg(F.first("text").alias("text"))
    sets = (
        texts.join(wanted, ["doc_id", "mark"])
        .select("key", "n_docs", "label", "blocks", "text")
        .mapInArrow(ngrams, "key binary, n_docs long, label string, blocks int, grams binary")
    )
    own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
    placed = (
        sets.withColumn("block", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("block", "other"))
        .withColumn("j", F.greatest("block", "other"))
        .select("label", "i", "j", "key", "n_docs", "block", "grams")
    )
    blocks = placed.groupBy("label", "i", "j").applyInArrow(_with_group(_verify(similarity)), f"label string, i int, j int, {VERIFIED}")
    return blocks


def _with_group(compare):
    def run(key: tuple[pa.Scalar, ...], tab: pa.Table) -> pa.Table:
        out = compare(key, tab)
        for place, name in enumerate(("label", "i", "j")):
            out = out.add_column(place, name, pa.array([key[place].as_py()] * out.num_rows, pa.string() if place == 0 else pa.int32()))
        return out

    return run
