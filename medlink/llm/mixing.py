"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives every document a probability for each domain. Nonnegative document rates are
then fitted by distributed projected-gradient least squares, so that the expected tokens of each domain match its target.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.llm.common import blocks_of, text_blocks, uniform
from medlink.llm.ngrams import codes_of, hash_runs, mix, runs
from medlink.llm.quality_mil import SPACES, labelled_sample

#: Labelled documents that the classifier is fitted on at most, a fixed pseudo-random choice of them.
SAMPLE_DOCS = 4000
BUCKETS = 1 << 18
EPOCHS, RATE, DECAY, LEAST_DOCS = 100, 0.05, 3e-5, 20
#: The fit of the rates ends when no domain misses its target by more than this share of the tokens, or when a pass takes
#: less than the second number off the squared misfit, as a share of it: then it is stationary.
TOLERANCE, STATIONARY = 1e-5, 1e-5
#: Multiples of a gradient step that one pass tries.
PARTS = (8.0, 2.0, 1.0, 0.5, 0.25, 2.0**-4, 2.0**-7, 2.0**-12)
#: Multiples of a plain gradient step over the largest curvature, for where those gain little: a short one always gets nearer.
PLAIN = (256.0, 64.0, 16.0, 4.0, 1.0)


def text_features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashed features, text number of each, words of each text): each feature once a text, in order of texts.

    A word counts as itself in lower case without outer signs, by its first five letters, and by its shape: runs of
    capitals, small letters, digits and single signs, and whether it repeats the word before.
    """
    codes, bounds = codes_of([t if len(t.lower()) != len(t) else t.lower() for t in texts])
    original, _ = codes_of(texts)
    start, end = runs(~SPACES[codes])
    doc = np.searchsorted(bounds, start, side="right") - 1
    n_words = np.bincount(doc, minlength=len(texts))
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), n_words
    letter = (codes >= 97) & (codes <= 122) | (codes >= 0xC0)
    stem_start, stem_end = runs(letter)
    stems = hash_runs(codes, stem_start, stem_end)
    beginnings = hash_runs(codes, stem_start, np.minimum(stem_end, stem_start + 5))
    stem_doc = np.searchsorted(bounds, stem_start, side="right") - 1
    kind = np.where(letter, np.where(original != codes, 1, 2), np.where((codes >= 48) & (codes <= 57), 3, codes)).astype(np.uint32)
    change = np.r_[True, kind[1:] != kind[:-1]] | np.r_[True, SPACES[codes[:-1]]]
    change &= ~SPACES[codes]
    at = np.r_[0, np.cumsum(change)]
    shapes = hash_runs(kind[change], at[start], at[end])
    words = hash_runs(codes, start, end)
    again = np.r_[False, (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])]
    features = np.concatenate([stems, mix(beginnings + np.uint64(7)), mix(shapes + again.astype(np.uint64) + np.uint64(1 << 33))])
    owner = np.concatenate([stem_doc, stem_doc, doc])
    pair = np.unique(owner.astype(np.int64) * BUCKETS + (features >> np.uint64(46)).astype(np.int64))
    return pair % BUCKETS, pair // BUCKETS, n_words


@dataclass
class DomainModel:
    """weights: by feature bucket and domain; bias: by domain."""

    domains: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def posteriors(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(probability of each domain, words) of each text; a text without words has the bias alone."""
        feature, doc, n_words = text_features(texts)
        return softmax(_logits(self.weights, feature, doc, len(texts)) + self.bias), n_words


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _logits(weights: np.ndarray, feature: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    size = np.maximum(1, np.bincount(doc, minlength=n)) ** 0.5
    return np.stack([np.bincount(doc, weights=w[feature], minlength=n) for w in weights.T], axis=1) / size[:, None]


def fit_domains(texts: list[str], domain: np.ndarray, names: list[str]) -> DomainModel:
    """Softmax regression by Adam; the logits are then scaled to fit a fifth of the sample kept out of the fit.

    Features found in few documents get no weight. With labels of one domain, or none, only the bias speaks.
    """
    k = len(names)
    share = (np.bincount(domain, minlength=k) + 0.5) / (len(domain) + 0.5 * k)
    model = DomainModel(names, np.zeros((BUCKETS, k), np.float32), np.log(share))
    if len(np.unique(domain)) < 2:
        return model
    parts, first = [], 0
    for block in blocks_of(texts):  # the driver holds the arrays of one block only
        found, of, _ = text_features(block)
        parts.append((found.astype(np.int32), (of + first).astype(np.int32)))
        first += len(block)
    feature, doc = (np.concatenate(c) for c in zip(*parts))
    del parts
    used, code, count = np.unique(feature, return_inverse=True, return_counts=True)
    keep = (count >= min(LEAST_DOCS, max(2, len(texts) // 100)))[code]  # fewer documents in a small sample
    code, doc = code[keep].astype(np.int32), doc[keep]
    learn = np.arange(len(texts)) % 5 != 0
    truth = np.eye(k)[domain]
    size = np.maximum(1, np.bincount(doc, minlength=len(texts))) ** 0.5
    w, b = np.zeros((len(used), k)), model.bias.copy()
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, EPOCHS + 1):
        error = (softmax(_logits(w, code, doc, len(texts)) + b) - truth) * learn[:, None] / learn.sum()
        scaled = error / size[:, None]
        grad = np.stack([np.bincount(code, weights=scaled[doc, j], minlength=len(used)) for j in range(k)], axis=1) + DECAY * w
        for i, (value, g) in enumerate(((w, grad), (b, error.sum(axis=0)))):
            state[2 * i] = 0.9 * state[2 * i] + 0.1 * g
            state[2 * i + 1] = 0.99 * state[2 * i + 1] + 0.01 * g * g
            value -= RATE * (4 if i == 0 else 1) * state[2 * i] / (1 - 0.9**step) / (np.sqrt(state[2 * i + 1] / (1 - 0.99**step)) + 1e-8)
    logits, rest = _logits(w, code, doc, len(texts)) + b, ~learn
    if rest.any():
        scales = np.geomspace(0.1, 3, 40)
        loss = [-np.log(softmax(logits[rest] * s)[np.arange(rest.sum()), domain[rest]] + 1e-12).mean() for s in scales]
        scale = scales[int(np.argmin(loss))]
        w, b = w * scale, b * scale
    model.weights[used], model.bias = w.astype(np.float32), b
    return model


def train(docs: DataFrame, labelled: DataFrame, domains: list[str], doc_id: str = "doc_id", text: str = "text", limit: int = SAMPLE_DOCS) -> DomainModel:
    """labelled: rows (doc_id, domain); other domains than the given ones and null ones are left out."""
    number = F.coalesce(*[F.when(F.col("domain") == d, F.lit(i)) for i, d in enumerate(domains)])
    coded = labelled.select("doc_id", number.alias("domain"))
    found = labelled_sample(docs, coded, "domain", limit, doc_id, text).toArrow()
    found = found.sort_by([("sample_id", "ascending"), ("sample_text", "ascending")])
    return fit_domains(found.column("sample_text").to_pylist(), found.column("label").to_numpy().astype(np.int64), domains)


def membership(model: DomainModel, text: Column) -> Column:
    """Struct of n_tokens (words) and posteriors (one per domain, in order) of a whole text; null counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        rows, words = [np.zeros((0, len(model.domains)))], [np.zeros(0, np.int64)]
        for block in text_blocks(texts):
            p, n = model.posteriors(block)
            rows.append(p)
            words.append(n)
        flat = np.concatenate(rows)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))
        return pa.StructArray.from_arrays([pa.array(np.concatenate(words).astype(np.int64)), lists], ["n_tokens", "posteriors"])

    return F.arrow_udf(run, "n_tokens long, posteriors array<double>").asNondeterministic()(text.cast("string"))


def blocked(rate: np.ndarray, pull: np.ndarray, top: float) -> np.ndarray:
    """Rates at a bound that the gradient pulls beyond it."""
    return (rate <= 0) & (pull <= 0) | (rate >= top) & (pull >= 0)


def rates_of(posteriors: np.ndarray, steps: np.ndarray, largest: float | None = None) -> np.ndarray:
    """Rates after the given steps, pairs of a move and the misfit it was made for, (n, 2, domains).

    The start is 1 for every document. A step moves the rates that aren't blocked, and puts them back into the bounds.
    """
    top = np.inf if largest is None else largest
    rate = np.ones(len(posteriors))
    for move, misfit in steps:
        rate = np.where(blocked(rate, posteriors @ misfit, top), rate, np.clip(rate + posteriors @ move, 0.0, top))
    return rate


def _sums(values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"at": pa.array(np.arange(len(values), dtype=np.int32)), "value": pa.array(values)})


@dataclass
class Fit:
    """steps: for rates_of and with_rates; misfit: the largest miss of a target, as a share of the tokens; kept: tokens taken for each token."""

    steps: np.ndarray
    misfit: float
    kept: float


def fit_rates(
    members: DataFrame, targets: list[float], total: float | None = None, largest: float | None = None, tolerance: float = TOLERANCE
) -> Fit:
    """Projected-gradient least squares for the documents' rates; members: n_tokens, posteriors.

    It minimises the squares of sum(rate * n_tokens * posteriors) less the targets' shares of ``total`` (all tokens, if
    not given) over rates >= 0. With ``largest``, over rates from 0 to ``largest``, and the targets are shares of whatever
    is taken, so that only documents of domains with too much are thinned: then projection is lazy, that is, steps add up
    before rates are cut to their bounds, which leads to the rates nearest to the start. The start is a rate of 1 for all.

    The gradient of a document's rate is its tokens times p' misfit. Documents that it pulls beyond a bound are blocked and
    stay. The others move in the metric of tokens, and for the domains of G = sum(n_tokens * p * p') over them alone, so
    blocked ones don't shorten the step; rates then go back into their bounds. A rate is a function of the posteriors and the steps so far, so a
    pass tries several multiples of a step, and of one without the metric of the domains, sends one small sum from each task, and the driver keeps the steps: domains
    numbers each. It ends at the tolerance, or where the misfit is stationary: then the targets are out of reach, which is
    said in a warning and in the result.
    """
    k = len(targets)
    share = np.array(targets, float) / sum(targets)
    shift, top = (np.zeros(k), np.inf) if largest is None else (share, float(largest))
    rows = members.select(F.col("n_tokens").cast("double"), "posteriors")

    def sums_at(steps: np.ndarray, moves: np.ndarray, misfit: np.ndarray) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """After the steps and each of the moves: tokens taken, these by domain (less their due share), and G."""

        def run(batches):
            out = np.zeros((len(moves), 1 + k + k * k))
            for batch in batches:
                n, p = batch.column(0).to_numpy(), batch.column(1).flatten().to_numpy().reshape(-1, k)
                p = p - shift
                pull = p @ misfit
                if largest is None:
                    base = rates_of(p, steps, top)
                    held = blocked(base, pull, top)
                else:
                    base, held = 1 + p @ steps[:, 0].sum(axis=0), False
                for at, move in enumerate(moves):
                    point = base + p @ move
                    rate = np.where(held, base, np.clip(point, 0, top))
                    free = ~blocked(rate, pull, top) if largest is None else (point > 0) & (point <= top)
                    out[at, 0] += n @ rate
                    out[at, 1 : 1 + k] += (rate * n) @ p
                    out[at, 1 + k :] += ((p[free] * n[free, None]).T @ p[free]).ravel()
            yield _sums(out.ravel())

        found = rows.mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        out = np.zeros(len(moves) * (1 + k + k * k))
        for r in found:
            out[r["at"]] = r["value"]
        return [(o[0], o[1 : 1 + k], o[1 + k :].reshape(k, k)) for o in out.reshape(len(moves), -1)]

    steps, still = np.zeros((0, 2, k)), np.zeros((1, k))
    state = sums_at(steps, still, np.zeros(k))[0]
    everything = state[0]
    if everything <= 0:
        return Fit(steps, 0.0, 0.0)
    wanted = share * (everything if total is None else total) if largest is None else np.zeros(k)
    state = sums_at(steps, still, wanted - state[1])[0]  # now with what is free to move

    def missed(s) -> float:
        return float(np.abs(wanted - s[1]).max() / max(1e-300, s[0] if largest is not None else wanted.sum()))

    def squares(s) -> float:
        return float(((wanted - s[1]) ** 2).sum())

    while missed(state) > tolerance:
        misfit = wanted - state[1]
        move = np.linalg.pinv(state[2], rcond=1e-10, hermitian=True) @ misfit
        steepest = misfit / max(1e-300, np.linalg.eigvalsh(state[2]).max())
        moves = np.concatenate([np.array(PARTS)[:, None] * move, np.array(PLAIN)[:, None] * steepest])
        states = sums_at(steps, moves, misfit)
        at = min(range(len(PARTS)), key=lambda i: squares(states[i]))
        if squares(states[at]) > 0.9 * squares(state):
            at = min(range(len(states)), key=lambda i: squares(states[i]))
        if not squares(states[at]) < (1 - STATIONARY) * squares(state):
            break
        steps, state = np.concatenate([steps, [[moves[at], misfit]]]), states[at]
    if largest is not None and len(steps):
        steps = np.repeat(steps[:, :1].sum(axis=0)[None], 2, axis=1)  # one step for all; who it pulls up stays at the top
    # posteriors add up to 1, so what was taken off them can be taken off the steps
    fit = Fit(steps - (steps @ shift)[..., None], missed(state), state[0] / everything)
    if fit.misfit > tolerance:
        warnings.warn(f"the targets are out of reach: one is missed by {fit.misfit:.3g} of the tokens ({fit.kept:.3g} of all are taken)", stacklevel=2)
    return fit


def with_rates(members: DataFrame, steps: np.ndarray, largest: float | None = None) -> DataFrame:
    """Add rate (see rates_of, here as an expression) and copies. copies: the rate, rounded up with a chance (a hash of the id) that makes its mean the rate.

    ``largest`` as in fit_rates.
    """
    top = F.lit(float("inf") if largest is None else float(largest))

    def along(step: Column) -> Column:
        products = F.zip_with("posteriors", step, lambda p, d: p * d)
        return F.aggregate(products, F.lit(0.0), lambda total, product: total + product)

    def taken(rate: Column, step: Column) -> Column:
        pull = along(step["misfit"])
        held = (rate <= 0) & (pull <= 0) | (rate >= top) & (pull >= 0)
        return F.when(held, rate).otherwise(F.least(top, F.greatest(F.lit(0.0), rate + along(step["move"]))))

    numbers = lambda row: F.array(*[F.lit(float(d)) for d in row])
    history = F.array(*[F.struct(numbers(m).alias("move"), numbers(e).alias("misfit")) for m, e in steps]) if len(steps) else None
    rate = F.lit(1.0) if history is None else F.aggregate(history, F.lit(1.0), taken)
    members = members.withColumn("rate", rate)
    whole = F.floor("rate")
    return members.withColumn(
        "copies", (whole + (uniform(F.col("doc_id"), F.lit("copies")) < F.col("rate") - whole).cast("int")).cast("int")
    )


def mix_documents(
    docs: DataFrame,
    labelled: DataFrame,
    targets: dict[str, float],
    store,
    doc_id: str = "doc_id",
    text: str = "text",
    total: float | None = None,
    largest: float | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_tokens, posteriors (in the targets' order), rate, copies and misfit.

    misfit: the largest miss of a target by the fitted rates, as a share of the tokens (see fit_rates), the same in every
    row; more than TOLERANCE where the targets are out of reach. ``store`` writes a table that is read many times. Null and empty texts have no tokens and the rate of their
    posteriors; repeated rows of an id get the same number of copies; an empty table gives no row.
    """
    model = train(docs, labelled, list(targets), doc_id, text)
    rows = docs.select(F.col(doc_id).alias("doc_id"), membership(model, F.col(text)).alias("m"))
    members = store(rows.select("doc_id", F.col("m.n_tokens").alias("n_tokens"), F.col("m.posteriors").alias("posteriors")))
    fit = fit_rates(members, list(targets.values()), total, largest)
    return with_rates(members, fit.steps, largest).withColumn("misfit", F.lit(fit.misfit))


def labelled_languages(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", lang: str = "lang") -> DataFrame:
    """A labelled table of (doc_id, domain): the language given for the documents that somebody has labelled."""
    known = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("domain"))
    return known.join(labels.select("doc_id").where("doc_id is not null").distinct(), "doc_id", "left_semi")
