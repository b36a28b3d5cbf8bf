"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages, only the bag is labelled. Each passage is encoded (measured figures, then a learned layer);
a gated attention gives each passage a weight within its document; the weighted mean of the encodings is scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.llm.common import held_out, text_blocks
from medlink.llm.ngrams import codes_of, hash_runs, mix, runs

#: Words of a passage; the last one of a document may be shorter.
PASSAGE_WORDS = 64
#: Labelled documents that the model is fitted on at most, a fixed pseudo-random choice of them.
SAMPLE_DOCS = 4000
HIDDEN, ATTENTION, EPOCHS, RATE, DECAY = 16, 8, 250, 0.02, 1e-4

SPACES = np.zeros(0x110000, bool)
SPACES[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = True
FEATURES = (
    "words", "word_length", "upper", "exclamations", "symbols", "digits", "other_signs", "line_feeds", "distinct",
    "repeats_last", "one_char", "repeated_windows", "capitals", "foreign",
)


def passage_features(texts: list[str], size: int = PASSAGE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(one row of FEATURES per passage, passages of each text); a text without words is one passage of zeros."""
    codes, bounds = codes_of(texts)
    start, end = runs(~SPACES[codes])
    first = np.searchsorted(start, bounds)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(len(texts)), n_words)
    place = np.arange(len(start)) - first[:-1][doc]
    n_passages = np.maximum(1, -(-n_words // size))
    out = np.zeros((n_passages.sum(), len(FEATURES)), np.float64)
    if not len(start):
        return out, n_passages
    passage = (np.cumsum(n_passages) - n_passages)[doc] + place // size
    lead = np.flatnonzero(place % size == 0)
    row, count = passage[lead], np.diff(np.r_[lead, len(start)])

    def per_word(values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values.astype(np.float64), lead) / count

    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE)
    lower = (codes >= 97) & (codes <= 122) | (codes >= 0xDF) & (codes < 0x2000)
    digit = (codes >= 48) & (codes <= 57)
    symbol = np.isin(codes, np.frombuffer("#*$%&|<>".encode("utf-32-le"), np.uint32))
    mark = codes == 33
    other = ~(upper | lower | digit | symbol | mark | SPACES[codes])

    def chars(mask: np.ndarray) -> np.ndarray:
        """Characters of a kind in each word."""
        total = np.r_[0, np.cumsum(mask)]
        return total[end] - total[start]

    length, words = end - start, hash_runs(codes, start, end)
    n_upper, n_lower = chars(upper), chars(lower)
    feeds = np.r_[0, np.cumsum(codes == 10)]
    next_start = np.r_[start[1:], len(codes)]
    _, group, times = np.unique(mix(words + mix(passage.astype(np.uint64))), return_inverse=True, return_counts=True)
    again = np.r_[False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]
    window = mix(doc.astype(np.uint64))
    for k in range(5):
        window = mix(window + np.r_[words[k:], np.zeros(min(k, len(words)), np.uint64)])
    inside = place + 5 <= n_words[doc]
    repeated = np.zeros(len(start))
    _, of, seen = np.unique(window[inside], return_inverse=True, return_counts=True)
    repeated[inside] = seen[of] > 1
    out[row] = np.stack(
        [
            np.minimum(count / size, 1),
            np.log1p(per_word(length)),
            np.add.reduceat(n_upper, lead) / np.maximum(1, np.add.reduceat(n_upper + n_lower, lead)),
            np.minimum(per_word(chars(mark)), 3),
            np.minimum(per_word(chars(symbol)), 3),
            np.minimum(per_word(chars(digit)), 3),
            np.minimum(per_word(chars(other)), 3),
            np.minimum(per_word(feeds[next_start] - feeds[end]), 1),
            per_word(1.0 / times[group]),
            per_word(again),
            per_word(length == 1),
            per_word(repeated),
            per_word((n_upper == 1) & upper[start] & (length > 1)),
            per_word(chars(codes >= 128)) / np.maximum(1, per_word(length)),
        ],
        axis=1,
    )
    return out, n_passages


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class MilModel:
    """Weights of the encoder, the gated attention and the scorer; constant: the score of a model without both labels."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, rows: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """Passages in order of their documents; every document has one at least."""
        w, start = self.weights, np.cumsum(counts) - counts
        of = np.repeat(np.arange(len(counts)), counts)
        x = (rows - self.mean) / self.scale
        h = np.tanh(x @ w["encode"] + w["encode_bias"])
        t, g = np.tanh(h @ w["value"]), _sigmoid(h @ w["gate"])
        e = (t * g) @ w["attend"]
        e = np.exp(e - np.maximum.reduceat(e, start)[of])
        a = e / np.add.reduceat(e, start)[of]
        z = np.add.reduceat(a[:, None] * h, start)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "of": of, "start": start, "p": _sigmoid(z @ w["score"] + w["score_bias"])}

    def score(self, rows: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(score, number of the passage with most weight) of each document."""
        if self.constant is not None:
            return np.full(len(counts), self.constant), np.zeros(len(counts), np.int64)
        f = self.forward(rows, counts)
        best = np.maximum.reduceat(f["a"], f["start"])[f["of"]]
        at = np.flatnonzero(f["a"] == best)
        _, lead = np.unique(f["of"][at], return_index=True)
        return f["p"], at[lead] - f["start"]


def fit(rows: np.ndarray, counts: np.ndarray, labels: np.ndarray, seed: int = 1) -> MilModel:
    """Fit by Adam on the cross entropy of the documents' labels. With a single label, or none, the score is constant."""
    if not len(labels) or labels.min() == labels.max():
        return MilModel(np.zeros(0), np.ones(0), {}, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    n = rows.shape[1]
    w = {
        "encode": rng.normal(0, n**-0.5, (n, HIDDEN)), "encode_bias": np.zeros(HIDDEN),
        "value": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)), "gate": rng.normal(0, HIDDEN**-0.5, (HIDDEN, ATTENTION)),
        "attend": rng.normal(0, ATTENTION**-0.5, ATTENTION), "score": rng.normal(0, HIDDEN**-0.5, HIDDEN), "score_bias": np.zeros(1),
    }
    scale = rows.std(axis=0)
    model = MilModel(rows.mean(axis=0), np.where(scale > 1e-9, scale, 1.0), w)
    first, second = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}
    for step in range(1, EPOCHS + 1):
        f = model.forward(rows, counts)
        of, start, h, t, g, a = (f[k] for k in ("of", "start", "h", "t", "g", "a"))
        ds = (f["p"] - labels) / len(labels)
        dz = ds[:, None] * w["score"]
        da = (dz[of] * h).sum(axis=1)
        de = a * (da - np.add.reduceat(a * da, start)[of])
        dtg = de[:, None] * w["attend"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dz[of] + dt @ w["value"].T + dg @ w["gate"].T) * (1 - h * h)
        grad = {
            "encode": f["x"].T @ dh, "encode_bias": dh.sum(axis=0), "value": h.T @ dt, "gate": h.T @ dg,
            "attend": (t * g).T @ de, "score": f["z"].T @ ds, "score_bias": np.array([ds.sum()]),
        }
        for k in w:
            d = grad[k] + DECAY * w[k]
            first[k] = 0.9 * first[k] + 0.1 * d
            second[k] = 0.999 * second[k] + 0.001 * d * d
            w[k] -= RATE * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and label (0 or 1) of at most ``limit`` labelled documents that aren't held out.

    The choice is the smallest hashes of the ids, so it is the same in every run. Null ids and labels are left out; a
    document labelled twice has the larger label, and of a repeated id the first text in order counts, so there are never
    more rows than ``limit``. The sample is so small that it is sent to the documents.
    """
    known = (
        labels.select(F.col("doc_id").cast("long").alias("sample_id"), F.col(label).cast("double").alias("label"))
        .where("sample_id is not null and label is not null")
        .where(~held_out(F.col("sample_id")))
        .groupBy("sample_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("sample_id"), "sample_id")
        .limit(limit)
    )
    texts = docs.select(F.col(doc_id).cast("long").alias("sample_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("sample_text"))
    found = texts.join(F.broadcast(known), "sample_id")
    return found.groupBy("sample_id").agg(F.min("sample_text").alias("sample_text"), F.max("label").alias("label"))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", limit: int = SAMPLE_DOCS) -> MilModel:
    """Encode the sample's passages on the cluster, then fit on the driver."""

    def encode(batches):
        for batch in batches:
            at = 0
            for block in text_blocks(batch.column(1)):
                rows, counts = passage_features(block)
                parts = np.split(rows.astype(np.float32), np.cumsum(counts)[:-1])
                yield pa.RecordBatch.from_pydict(
                    {
                        "sample_id": batch.column(0).slice(at, len(block)),
                        "label": batch.column(2).slice(at, len(block)),
                        "rows": pa.array([p.tobytes() for p in parts], pa.binary()),
                    }
                )
                at += len(block)

    sample = labelled_sample(docs, labels, label, limit, doc_id, text)
    found = sample.mapInArrow(encode, "sample_id long, label double, rows binary").toArrow()
    found = found.sort_by([("sample_id", "ascending"), ("rows", "ascending")]) if found.num_rows else found
    rows = [np.frombuffer(b, np.float32).reshape(-1, len(FEATURES)) for b in found.column("rows").to_pylist()]
    counts = np.array([len(r) for r in rows], np.int64)
    stacked = np.concatenate(rows).astype(np.float64) if rows else np.zeros((0, len(FEATURES)))
    return fit(stacked, counts, (found.column("label").to_numpy() > 0).astype(np.float64))


def quality(model: MilModel, text: Column) -> Column:
    """Struct of score (0 to 1, 1: good) and top_passage (the one with most weight, from 0) of a whole text."""

    def run(texts: pa.Array) -> pa.Array:
        scores, tops = [], []
        for block in text_blocks(texts):
            score, top = model.score(*passage_features(block))
            scores.append(score)
            tops.append(top)
        flat = (np.concatenate(scores), np.concatenate(tops)) if scores else (np.zeros(0), np.zeros(0, np.int64))
        return pa.StructArray.from_arrays([pa.array(flat[0], pa.float64()), pa.array(flat[1].astype(np.int32), pa.int32())], ["score", "top_passage"])

    return F.arrow_udf(run, "score double, top_passage int").asNondeterministic()(text.cast("string"))


def classify(docs: DataFrame, model: MilModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, top_passage.

    Null and empty texts are scored as empty, with a score of their own; repeated rows are scored alike, each for itself; a
    null doc_id is not held out; an empty table gives no row; other columns don't matter.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"), quality(model, F.col(text)).alias("q"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("q.score").alias("score"),
        (F.col("q.score") >= threshold).cast("int").alias("predicted"),
        F.col("q.top_passage").alias("top_passage"),
    )
