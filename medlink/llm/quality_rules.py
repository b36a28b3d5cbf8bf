"""Weak supervision of quality: rules vote or abstain, their accuracies are estimated, the posterior decides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.llm.common import text_blocks
from medlink.llm.ngrams import codes_of, hash_runs, mix, runs

STATS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks", "n_echoes",
)
#: Characters that separate words: the space and U+0009 to U+000D.
SEPARATORS = np.zeros(0x110000, bool)
SEPARATORS[[0x20, *range(0x09, 0x0E)]] = True
SYMBOLS = "#*$%&|<>"
WINDOW = 5


def text_stats(texts: list[str]) -> np.ndarray:
    """One row of STATS (whole numbers) per text.

    Words are runs without separators. n_repeat_words: words inside windows of five words found twice or more in the
    text, the first included. n_dup_lines: lines with a word, equal to an earlier line; n_lines: lines with a word.
    n_upper of n_letters: capitals among cased letters. n_marks: exclamation marks. n_echoes: words equal to the one
    before. Words, windows and lines are compared by 64-bit hashes.
    """
    codes, bounds = codes_of(texts)
    n = len(texts)
    out = np.zeros((n, len(STATS)), np.int64)
    word_char = ~SEPARATORS[codes]
    start, end = runs(word_char)
    first = np.searchsorted(start, bounds)
    n_words = np.diff(first)
    doc = np.repeat(np.arange(n), n_words)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.r_[0, np.cumsum(mask)]
        return total[bounds[1:]] - total[bounds[:-1]]

    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7)
    lower = (codes >= 97) & (codes <= 122) | (codes >= 0xDF) & (codes < 0x250) & (codes != 0xF7)
    out[:, 0], out[:, 1] = n_words, per_text(word_char)
    out[:, 2] = per_text(np.isin(codes, np.frombuffer(SYMBOLS.encode("utf-32-le"), np.uint32)))
    out[:, 6], out[:, 7], out[:, 8] = per_text(upper), per_text(upper | lower), per_text(codes == 33)
    if not len(start):
        return out
    # lines with a word
    line_start, line_end = runs(codes != 10)
    line_first = np.searchsorted(start, line_start)
    filled = np.searchsorted(start, line_end) > line_first
    line_start, line_end = line_start[filled], line_end[filled]
    line_doc = np.searchsorted(bounds, line_start, side="right") - 1
    line = mix(hash_runs(codes, line_start, line_end) + mix(line_doc.astype(np.uint64)))
    _, first_of = np.unique(line, return_index=True)
    out[:, 5] = np.bincount(line_doc, minlength=n)
    out[:, 3] = out[:, 5] - np.bincount(line_doc[first_of], minlength=n)
    # repeated windows
    words = hash_runs(codes, start, end)
    out[:, 9] = np.bincount(doc[1:][(words[1:] == words[:-1]) & (doc[1:] == doc[:-1])], minlength=n)
    window = mix(doc.astype(np.uint64))
    for k in range(WINDOW):
        window = mix(window + np.r_[words[k:], np.zeros(min(k, len(words)), np.uint64)])
    place = np.arange(len(start)) - first[:-1][doc]
    whole = np.flatnonzero(place + WINDOW <= n_words[doc])
    _, of, seen = np.unique(window[whole], return_inverse=True, return_counts=True)
    at = whole[seen[of] > 1]
    cover = np.zeros(len(start) + 1, np.int64)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + WINDOW, -1)
    out[:, 4] = np.bincount(doc[np.cumsum(cover)[:-1] > 0], minlength=n)
    return out


def stats(text: Column) -> Column:
    """Struct of STATS of a whole text; null counts as empty."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [text_stats(block) for block in text_blocks(texts)]
        flat = np.concatenate(rows) if rows else np.zeros((0, len(STATS)), np.int64)
        return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(c)) for c in flat.T], list(STATS))

    kind = ", ".join(f"{s} long" for s in STATS)
    return F.arrow_udf(run, kind).asNondeterministic()(text.cast("string"))


def base_failed(s: Column) -> Column:
    return (s["n_words"] < 10) | (100 * s["n_repeat_words"] > 20 * s["n_words"])


def default_rules(s: Column) -> dict[str, Column]:
    """Each rule votes 1 (good), 0 (bad) or abstains (-1); s: struct of STATS."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, 0).when(good, 1).otherwise(-1)

    words = F.greatest(s["n_words"], F.lit(1))
    chars = F.greatest(s["word_chars"], F.lit(1))
    return {
        "enough_words": vote(s["n_words"] >= 20, s["n_words"] < 10),
        "word_length": vote((chars >= 2.5 * words) & (chars <= 12 * words), (chars < 1.5 * words) | (chars > 20 * words)),
        "few_symbols": vote(s["n_symbols"] * 20 <= words, s["n_symbols"] * 5 > words),
        "few_marks": vote(s["n_marks"] * 20 <= words, s["n_marks"] * 5 > words),
        "lower_case": vote(s["n_upper"] * 5 <= s["n_letters"], s["n_upper"] * 2 > s["n_letters"]),
        "letters": vote(s["n_letters"] * 10 >= chars * 8, s["n_letters"] * 10 < chars * 5),
        "new_lines": vote(s["n_dup_lines"] * 10 <= s["n_lines"], s["n_dup_lines"] * 10 > s["n_lines"] * 4),
        "new_windows": vote(s["n_repeat_words"] * 20 <= words, s["n_repeat_words"] * 5 > words),
        "no_echo": vote(s["n_echoes"] * 20 <= words, s["n_echoes"] * 5 > words),
    }


@dataclass
class LabelModel:
    """Kind 0 is good; kind j + 1 is what rule j catches. bad: chance that a voting rule votes bad, by kind and rule.

    So a rule's accuracy is 1 - bad[0] on good documents, and bad[k] on those of kind k.
    """

    rules: list[str]
    bad: np.ndarray
    share: np.ndarray
    rounds: int = 0

    def kinds(self, votes: np.ndarray) -> np.ndarray:
        """Probability of each kind for rows of votes. Abstaining says nothing."""
        log = (votes == 0) @ np.log(self.bad).T + (votes == 1) @ np.log1p(-self.bad).T + np.log(self.share)
        log = np.exp(log - log.max(axis=1, keepdims=True))
        return log / log.sum(axis=1, keepdims=True)

    def accuracies(self) -> dict[str, tuple[float, float]]:
        """Of each rule, how often its votes are right on good documents, and on those of the kind it catches."""
        return {r: (1 - float(self.bad[0, i]), float(self.bad[i + 1, i])) for i, r in enumerate(self.rules)}

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of good."""
        return self.kinds(votes)[:, 0]


#: What is held before any vote is seen, as (chance, share of the documents that it counts like): that a rule votes bad
#: on a good document, on the kind it catches, on another bad kind; and that a document is good.
ON_GOOD, ON_OWN, ON_OTHER, GOOD = (0.01, 0.5), (0.9, 0.002), (0.1, 0.002), (0.85, 0.05)
#: A rule that alone, with no other bad vote, votes bad on more than this share of all documents is taken to be wrong on
#: good ones: it has no kind of its own, and its bad votes count only as far as others agree.
LONE = 0.1


def estimate(patterns: np.ndarray, counts: np.ndarray, rules: list[str], rounds: int = 300, tolerance: float = 1e-6) -> LabelModel:
    """Expectation-maximisation over distinct vote patterns and their counts.

    Rules catch different kinds of bad documents and seldom agree, so each rule has a bad kind of its own: with one bad
    class for all, a rarer kind would be taken for noise of its rule. The prior counts keep every kind's role and keep
    estimates away from 0 and 1; a rule that seldom votes bad alone is taken to err. Without a document they decide.
    """
    n, total = len(rules), max(1.0, float(counts.sum()))
    prior = np.full((n + 1, n), ON_OTHER[0])
    prior[0] = ON_GOOD[0]
    prior[np.arange(1, n + 1), np.arange(n)] = ON_OWN[0]
    weight = np.full((n + 1, n), ON_OTHER[1])
    weight[0] = ON_GOOD[1]
    weight *= total
    share = np.r_[GOOD[0], np.full(n, (1 - GOOD[0]) / n)]
    said_bad, said = (patterns == 0).astype(float), (patterns >= 0).astype(float)
    lone = counts @ (said_bad * (said_bad.sum(axis=1, keepdims=True) == 1)) / total
    weak = np.flatnonzero(lone > LONE)
    prior[0, weak] = lone[weak]
    share[1 + weak] = 1e-12
    model = LabelModel(rules, prior.copy(), share.copy())
    for step in range(1, rounds + 1):
        before = np.r_[model.bad.ravel(), model.share]
        kinds = model.kinds(patterns) * counts[:, None]
        model.bad = (kinds.T @ said_bad + prior * weight) / (kinds.T @ said + weight)
        model.share = (kinds.sum(axis=0) + share * GOOD[1] * total) / (counts.sum() + GOOD[1] * total)
        model.rounds = step
        if np.abs(np.r_[model.bad.ravel(), model.share] - before).max() < tolerance:
            break
    return model


def fit(stated: DataFrame, stats_column: str = "stats", rules=default_rules) -> LabelModel:
    """Estimate from all documents. Their vote patterns are counted on the cluster: at most 3 ** rules rows come back."""
    votes = rules(F.col(stats_column))
    rows = stated.groupBy(*[v.alias(k) for k, v in votes.items()]).agg(F.count(F.lit(1)).alias("n")).collect()
    rows = sorted(tuple(r) for r in rows)
    table = np.array(rows, np.int64).reshape(-1, len(votes) + 1)
    return estimate(table[:, :-1], table[:, -1].astype(np.float64), list(votes))


def with_posterior(rows: DataFrame, model: LabelModel, stats_column: str = "stats", rules=default_rules) -> DataFrame:
    """Add posterior, the probability that a document is good, from its rules' votes.

    The posteriors of all vote patterns, 3 ** rules of them whatever the data, are sent to the rows as a table.
    """
    n = len(model.rules)
    code = np.arange(3**n)
    patterns = np.stack([code // 3**j % 3 - 1 for j in range(n)], axis=1)
    spark = rows.sparkSession
    table = spark.createDataFrame(
        pa.table({"vote_code": pa.array(code.astype(np.int32)), "posterior": pa.array(model.posterior(patterns))})
    )
    votes = rules(F.col(stats_column)).values()
    own = sum((v + 1) * 3**j for j, v in enumerate(votes)).cast("int")
    return rows.withColumn("vote_code", own).join(F.broadcast(table), "vote_code", "left").drop("vote_code")


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, store=None) -> DataFrame:
    """One row per document: doc_id, the base figures, base_failed, posterior and kept.

    kept is false for base_failed documents and else true where the posterior is ``threshold`` or more. Null texts count
    as empty; repeated rows are judged alike. ``store`` keeps the figures (a function of a table), as they are read twice.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), stats(F.col(text)).alias("stats"))
    rows = store(rows) if store else rows
    model = fit(rows)
    s = F.col("stats")
    return with_posterior(rows, model).select(
        "doc_id", *[s[c].alias(c) for c in STATS[:5]], base_failed(s).alias("base_failed"), "posterior"
    ).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
