"""Toxicity: a linear-chain conditional random field tags words; its marginals give document scores and offsets.

Two tags, clean and toxic. A word's features are hashes of itself, its first letters, its ending and its case; tags of
neighbours interact. Labels come by document, so tokens of a bounded sample are labelled first: in toxic documents, the
words, and words with the beginnings, that hardly occur in others.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.llm.common import blocks_of, held_out, text_blocks
from medlink.llm.ngrams import codes_of, hash_runs, mix, runs, word_chars
from medlink.llm.quality_mil import labelled_sample

#: Labelled documents that the model is fitted on at most, a fixed pseudo-random choice of them.
SAMPLE_DOCS = 4000
#: Hash buckets of the features' weights.
BUCKETS = 1 << 18
SHIFT = np.uint32(32 - 18)
PREFIXES = (3, 4, 5, 6, 8)
#: Passes over all tokens of the sample, more of them if it is small, in steps of so many texts, at falling rates.
PASSES, LEAST_STEPS, STEP_TEXTS, RATES, DECAY = 4, 200, 50, (0.1, 0.01), 1e-5
#: A feature labels tokens from so many toxic documents on, if at least so large a share of its documents is toxic.
LEAST_DOCS, LEAST_SHARE = 5, 0.85


def tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(start, end in the text, text number of each word, 32-bit feature hashes: one row a word)."""
    lowered = [t.lower() if len(t.lower()) == len(t) else t for t in texts]
    codes, bounds = codes_of(lowered)
    start, end = runs(word_chars()[codes])
    doc = np.searchsorted(bounds, start, side="right") - 1
    length = end - start
    columns = [hash_runs(codes, start, end)]
    for k in PREFIXES:
        columns.append(mix(hash_runs(codes, start, np.minimum(end, start + k)) + np.uint64(k)))
    columns.append(mix(hash_runs(codes, np.maximum(start, end - 3), end) + np.uint64(101)))
    original, _ = codes_of(texts)
    changed = np.r_[0, np.cumsum(original != codes)]
    capitals = changed[end] - changed[start]
    shape = np.minimum(length, 12) * 4 + np.where(capitals == 0, 0, np.where(capitals == 1, 1, np.where(capitals == length, 2, 3)))
    columns.append(mix(shape.astype(np.uint64) + np.uint64(1 << 40)))
    features = np.stack([(c >> np.uint64(32)).astype(np.uint32) for c in columns], axis=1)
    return start - bounds[doc], end - bounds[doc], doc, features


def _times(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices, scaled to a sum of 1; entries are the rows 00, 01, 10, 11 of a (4, n) array."""
    out = np.empty(y.shape)
    out[0] = x[0] * y[0] + x[1] * y[2]
    out[1] = x[0] * y[1] + x[1] * y[3]
    out[2] = x[2] * y[0] + x[3] * y[2]
    out[3] = x[2] * y[1] + x[3] * y[3]
    out /= out.sum(axis=0)
    return out


def scan(first: np.ndarray, steps: np.ndarray, block: int = 64) -> np.ndarray:
    """Running products of 2 x 2 matrices with positive entries along a chain, each scaled to a sum of 1.

    first[i] starts the chain anew at i (a text begins); steps: (4, n), entries 00, 01, 10, 11. Returned: product of the
    matrices from the start of i's text up to i. The chain is cut into blocks that advance together, then their products
    are joined by the same scan, so any number of texts of any lengths takes about block + log steps of whole arrays.
    """
    n = steps.shape[1]
    if n <= block:
        out = steps.copy()
        for i in range(1, n):
            if not first[i]:
                out[:, i] = _times(out[:, i - 1 : i], out[:, i : i + 1])[:, 0]
        return out
    pad = -n % block
    identity = np.repeat(np.array([[1.0], [0.0], [0.0], [1.0]]), pad, axis=1)
    # one row of blocks per place within a block
    m = np.ascontiguousarray(np.concatenate([steps, identity], axis=1).reshape(4, -1, block).transpose(2, 0, 1))
    new = np.ascontiguousarray(np.r_[first, np.zeros(pad, bool)].reshape(-1, block).T)
    for i in range(1, block):
        m[i] = np.where(new[i], m[i], _times(m[i - 1], m[i]))
    begun = np.logical_or.accumulate(new, axis=0)
    before = scan(begun[-1], m[-1], block)  # product from the text's start to the end of each block
    for i in range(block):
        m[i, :, 1:] = np.where(begun[i, 1:], m[i, :, 1:], _times(before[:, :-1], m[i, :, 1:]))
    return m.transpose(1, 2, 0).reshape(4, -1)[:, :n]


def marginals(emission: np.ndarray, transition: np.ndarray, doc: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
    """Forward-backward: (chance of tag 1 of each word, expected number of each pair of neighbours' tags, if asked for).

    emission: score of tag 1 against 0; transition: scores (2, 2); words of a text are in a row.
    """
    n = len(emission)
    if not n:
        return np.zeros(0), np.zeros((2, 2)) if pairs else None
    first = np.r_[True, doc[1:] != doc[:-1]]
    last = np.r_[first[1:], True]
    weight = np.exp(np.clip(emission, -30, 30))
    t = np.exp(transition)
    psi = np.empty((4, n))  # from the tag before (rows) to this
    psi[0], psi[1], psi[2], psi[3] = t[0, 0], t[0, 1] * weight, t[1, 0], t[1, 1] * weight
    psi[0, first] = psi[2, first] = 1.0  # no tag before: both rows alike
    psi[1, first] = psi[3, first] = weight[first]
    alpha = scan(first, psi)[:2].copy()
    alpha /= alpha.sum(axis=0)
    # backwards: beta of a word is the product of what follows it in its text
    after = np.ones((4, n))
    after[:, :-1] = psi[:, 1:]
    after[:, last] = 1.0
    back = scan(last[::-1].copy(), after[[0, 2, 1, 3], ::-1])[:, ::-1]
    beta = back[:2] + back[2:]
    both = alpha * beta
    chance = both[1] / both.sum(axis=0)
    if not pairs:
        return chance, None
    inner = np.flatnonzero(~first)
    joint = psi[:, inner] * alpha[:, inner - 1][[0, 0, 1, 1]] * beta[:, inner][[0, 1, 0, 1]]
    return chance, (joint / joint.sum(axis=0)).sum(axis=1).reshape(2, 2)


@dataclass
class ToxicModel:
    """weights: by feature bucket; calibration: document score from (bias, highest marginal's log odds, log of their sum)."""

    weights: np.ndarray
    bias: float
    transition: np.ndarray
    calibration: np.ndarray

    def emission(self, features: np.ndarray) -> np.ndarray:
        return self.weights[features >> SHIFT].sum(axis=1) + self.bias

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, text number, chance of being toxic) of each word."""
        start, end, doc, features = tokens(texts)
        return start, end, doc, marginals(self.emission(features), self.transition, doc)[0]

    def score(self, texts: list[str]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """(score, offending spans: runs of words likelier toxic than not) of each text."""
        start, end, doc, chance = self.words(texts)
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        hit = np.flatnonzero(chance > 0.5)
        for i, joined in zip(hit.tolist(), np.r_[False, (np.diff(hit) == 1) & (doc[hit[1:]] == doc[hit[:-1]])].tolist() if len(hit) else []):
            here = spans[doc[i]]
            here.append((here.pop()[0] if joined else int(start[i]), int(end[i])))
        return sigmoid(document_figures(chance, doc, len(texts)) @ self.calibration), spans


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def document_figures(chance: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """(1, log odds of the highest marginal, log of the expected number of toxic words) of each text."""
    top, total = np.full(n, 1e-6), np.zeros(n)
    np.maximum.at(top, doc, np.clip(chance, 1e-6, 1 - 1e-6))
    np.add.at(total, doc, np.where(chance > 1e-3, chance, 0))
    return np.stack([np.ones(n), np.log(top / (1 - top)) / 5, np.log1p(total)], axis=1)


def label_tokens(features: np.ndarray, doc: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Tokens of toxic documents with a feature, other than the ending and the case, that hardly occurs in others."""
    out = np.zeros(len(doc), bool)
    for k in range(1 + len(PREFIXES)):
        _, code = np.unique(features[:, k], return_inverse=True)
        code = code.astype(np.int32)
        pair = np.unique(code.astype(np.int64) * len(toxic) + doc)
        owner, of = (pair // len(toxic)).astype(np.int32), (pair % len(toxic)).astype(np.int32)
        del pair
        in_all = np.bincount(owner)
        in_toxic = np.bincount(owner, weights=toxic[of], minlength=len(in_all))
        out |= ((in_toxic >= LEAST_DOCS) & (in_toxic >= LEAST_SHARE * in_all))[code]
    return out & toxic[doc]


def fit(texts: list[str], toxic: np.ndarray) -> ToxicModel:
    """Fit by Adam on the likelihood of the tags of all tokens, some texts a step; then calibrate document scores.

    With a single document label, or none, scores are constant.
    """
    share = float(toxic.mean()) if len(toxic) else 0.0
    model = ToxicModel(np.zeros(BUCKETS, np.float32), -4.0, np.zeros((2, 2)), np.array([np.log((share + 1e-3) / (1 - share + 1e-3)), 0.0, 0.0]))
    if len(np.unique(toxic)) < 2:
        return model
    parts, first = [], 0
    for block in blocks_of(texts):  # the driver holds the arrays of one block only
        _, _, of, found = tokens(block)
        parts.append((of.astype(np.int32) + first, found))
        first += len(block)
    doc, features = (np.concatenate(c) for c in zip(*parts))
    del parts
    tag = label_tokens(features, doc, toxic)
    ends = np.searchsorted(doc, np.arange(len(texts) + 1))
    used = np.unique(features >> SHIFT)
    packed = np.searchsorted(used, features >> SHIFT).astype(np.int32)
    w, b, t = np.zeros(len(used)), model.bias, model.transition
    state = [np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0, np.zeros((2, 2)), np.zeros((2, 2))]
    order = np.argsort(mix(np.arange(len(texts), dtype=np.uint64)), kind="stable")  # the same in every run
    groups = [np.sort(order[low : low + STEP_TEXTS]) for low in range(0, len(texts), STEP_TEXTS)]
    n, steps = max(1.0, float(tag.sum()) / len(groups)), max(LEAST_STEPS, PASSES * len(groups))
    for step in range(1, steps + 1):
        rows = np.concatenate([np.arange(ends[i], ends[i + 1]) for i in groups[(step - 1) % len(groups)]])
        if not len(rows):
            continue
        code, of, y = packed[rows], doc[rows], tag[rows]
        chance, pairs = marginals(w[code].sum(axis=1) + b, t, of, pairs=True)
        gold, inner = np.zeros((2, 2)), of[1:] == of[:-1]
        np.add.at(gold, (y[:-1][inner].astype(int), y[1:][inner].astype(int)), 1)
        d = (chance - y) / n
        grads = (np.bincount(code.ravel(), weights=np.repeat(d, code.shape[1]), minlength=len(used)) + DECAY * w, d.sum(), (pairs - gold) / n)
        rate = RATES[0] * (RATES[1] / RATES[0]) ** (step / steps)
        moved = []
        for k, g in enumerate(grads):
            state[2 * k] = 0.9 * state[2 * k] + 0.1 * g
            state[2 * k + 1] = 0.99 * state[2 * k + 1] + 0.01 * g * g
            moved.append(rate * state[2 * k] / (1 - 0.9**step) / (np.sqrt(state[2 * k + 1] / (1 - 0.99**step)) + 1e-8))
        w, b, t = w - moved[0], b - moved[1], t - moved[2]
    model.weights[used] = w.astype(np.float32)
    model.bias, model.transition = float(b), t
    del packed
    x, c = np.zeros((len(texts), 3)), np.zeros(3)
    for low in range(0, len(texts), 100):
        high = min(low + 100, len(texts))
        words = slice(ends[low], ends[high])
        chance, _ = marginals(model.emission(features[words]), model.transition, doc[words])
        x[low:high] = document_figures(chance, doc[words] - low, high - low)
    for _ in range(30):  # Newton steps of a logistic regression, slightly damped
        p = sigmoid(x @ c)
        c = c - np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.eye(3) * 1e-2, x.T @ (p - toxic) + 1e-2 * c)
    model.calibration = c
    return model


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = SAMPLE_DOCS) -> ToxicModel:
    """Fit on the driver, on whole texts of a bounded sample."""
    found = labelled_sample(docs, labels, label, limit, doc_id, text).toArrow().sort_by([("sample_id", "ascending"), ("sample_text", "ascending")])
    return fit(found.column("sample_text").to_pylist(), found.column("label").to_numpy() > 0)


def toxicity(model: ToxicModel, text: Column) -> Column:
    """Struct of score (0 to 1) and spans (start, end offsets in characters of offending words) of a whole text."""

    def run(texts: pa.Array) -> pa.Array:
        scores, spans = [], []
        for block in text_blocks(texts):
            score, found = model.score(block)
            scores += score.tolist()
            spans += [[{"start": a, "end": b} for a, b in s] for s in found]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, kind)], ["score", "spans"])

    return F.arrow_udf(run, "score double, spans array<struct<start int, end int>>").asNondeterministic()(text.cast("string"))


def classify(docs: DataFrame, model: ToxicModel, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, spans.

    Null and empty texts have no words and no span, and a score all the same; repeated rows are scored alike, each for
    itself; a null doc_id is not held out; an empty table gives no row; other columns don't matter.
    """
    scored = docs.select(F.col(doc_id).alias("doc_id"), toxicity(model, F.col(text)).alias("t"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("t.score").alias("score"),
        (F.col("t.score") >= threshold).cast("int").alias("predicted"),
        F.col("t.spans").alias("spans"),
    )
