"""Quality, rules, mixing, toxicity, neighbours and the pipeline against brute force, held-out rows and odd rows."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from medlink.llm import ann, mixing, quality_mil, quality_rules, toxicity
from medlink.llm.common import held_out, stored, table

SF = "/root/testdata/sf0.01"
ODD = [None, "", " \n ", "one", "a b c d e f g h i j " * 2000, "x\ny\nx\n\n x \ny", "!! $$ ||", "É" * 70000, "same same same same same same"]
SCHEMA = "doc_id long, text string, label int, score double, stats string, posterior double, row int, n_tokens int, rate int, m int"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, 1, 0.5, "s", 0.5, 1, 1, 1, 1) for i, t in enumerate(ODD)] + [(None, "null id", *[None] * 8), (3, "one", *[None] * 8)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, SF, "documents")


@pytest.fixture(scope="module")
def labels(spark):
    return table(spark, SF, "labels")


def accuracy(scored, labels, label):
    rows = scored.where("held_out").join(labels.where(f"{label} is not null"), "doc_id").select("score", "predicted", label).collect()
    truth, score = np.array([r[2] for r in rows]), np.array([r[0] for r in rows])
    order = np.argsort(np.argsort(score))
    n = truth.sum()
    auc = (order[truth == 1].sum() - n * (n - 1) / 2) / (n * (len(truth) - n))
    return auc, np.mean([r[1] == r[2] for r in rows])


def test_quality_on_held_out_rows(docs, labels, odd):
    model = quality_mil.train(docs, labels)
    auc, right = accuracy(quality_mil.classify(docs, model), labels, "quality")
    assert auc > 0.95 and right > 0.95
    rows = quality_mil.classify(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (0, 1, 2)}) == 1
    assert quality_mil.classify(odd.limit(0), model).count() == 0
    none = quality_mil.train(docs, labels.limit(0))
    assert none.constant == 0.5 and quality_mil.train(docs, labels.withColumn("quality", F.lit(None).cast("int"))).constant == 0.5
    assert quality_mil.train(docs, labels.withColumn("quality", F.lit(1))).constant == 1.0


def test_attention_gradient():
    """The fit lowers the loss, and attention sums to one within each document."""
    rng = np.random.default_rng(0)
    counts = rng.integers(1, 6, 60)
    rows = rng.normal(size=(counts.sum(), len(quality_mil.FEATURES)))
    of = np.repeat(np.arange(60), counts)
    truth = np.array([rows[of == d, 0].max() > 0.8 for d in range(60)], float)  # one good passage is enough
    model = quality_mil.fit(rows, counts, truth)
    f = model.forward((rows), counts)
    assert np.allclose(np.add.reduceat(f["a"], f["start"]), 1)
    assert ((f["p"] > 0.5) == truth).mean() > 0.9


def test_labels_of_held_out_rows_change_nothing(spark, docs, labels):
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality_mil.train(docs, labels), quality_mil.train(docs, turned)
    assert all(np.array_equal(a.weights[k], b.weights[k]) for k in a.weights)


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    count = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    cover = {k for i in range(len(words) - 4) if count[tuple(words[i : i + 5])] > 1 for k in range(i, i + 5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)]


def test_rules(spark, docs, labels, odd):
    texts = [t or "" for t in ODD] + [r["text"] for r in docs.limit(200).collect()]
    assert quality_rules.text_stats(texts)[:, :5].tolist() == [brute_stats(t) for t in texts]
    judged = quality_rules.judge(docs, store=stored)
    rows = judged.join(labels, "doc_id").select("kept", "base_failed", "quality").collect()
    good = [r for r in rows if r["quality"] == 1 and not r["base_failed"]]
    bad = [r for r in rows if r["quality"] == 0]
    assert np.mean([r["kept"] for r in good]) > 0.99 and np.mean([not r["kept"] for r in bad]) > 0.9
    assert not any(r["kept"] and r["base_failed"] for r in rows)
    got = {r["doc_id"]: r for r in quality_rules.judge(odd).collect()}
    assert len(got) == len(ODD) + 1 and not got[0]["kept"] and got[4]["base_failed"]
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_rule_estimates_recover_accuracies():
    """Votes drawn from known kinds: shares and accuracies come back."""
    rng = np.random.default_rng(3)
    rules = ["a", "b", "c"]
    kind = rng.choice(4, p=[0.8, 0.1, 0.06, 0.04], size=60_000)
    bad = np.array([[0.01, 0.02, 0.01], [0.9, 0.1, 0.1], [0.05, 0.95, 0.05], [0.1, 0.1, 0.9]])
    votes = np.where(rng.random((len(kind), 3)) < bad[kind], 0, 1)
    votes[rng.random(votes.shape) < 0.1] = -1
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.estimate(patterns, counts.astype(float), rules)
    assert abs(model.share[0] - 0.8) < 0.03 and np.abs(model.bad[0] - bad[0]).max() < 0.02
    assert (model.posterior(votes)[kind == 0] > 0.5).mean() > 0.95 and (model.posterior(votes)[kind > 0] < 0.5).mean() > 0.75


def plain_estimate(votes, rules, rounds):
    """Expectation-maximisation document by document, in plain loops, from the same priors."""
    n, total = len(rules), len(votes)
    kinds, good = n + 1, quality_rules.GOOD
    held = [[quality_rules.ON_GOOD[0] if k == 0 else quality_rules.ON_OWN[0] if k == r + 1 else quality_rules.ON_OTHER[0] for r in range(n)] for k in range(kinds)]
    weight = [(quality_rules.ON_GOOD if k == 0 else quality_rules.ON_OTHER)[1] * total for k in range(kinds)]
    first = [good[0], *[(1 - good[0]) / n] * n]
    bad, share = [], []

    def odds(row):
        out = []
        for k in range(kinds):
            x = share[k]
            for r, v in enumerate(row):
                x *= {0: bad[k][r], 1: 1 - bad[k][r], -1: 1.0}[int(v)]
            out.append(x)
        return [x / sum(out) for x in out]

    for r in range(n):
        alone = sum(row[r] == 0 and list(row).count(0) == 1 for row in votes) / total
        if alone > quality_rules.LONE:
            held[0][r], first[r + 1] = alone, 1e-12
    bad, share = [row[:] for row in held], first[:]
    for _ in range(rounds):
        belongs = [odds(row) for row in votes]
        for k in range(kinds):
            for r in range(n):
                voted = sum(b[k] for b, row in zip(belongs, votes) if row[r] >= 0)
                against = sum(b[k] for b, row in zip(belongs, votes) if row[r] == 0)
                bad[k][r] = (against + held[k][r] * weight[k]) / (voted + weight[k])
            share[k] = (sum(b[k] for b in belongs) + first[k] * good[1] * total) / (total + good[1] * total)
    return [odds(row)[0] for row in votes]


def test_rule_posteriors_are_plain_expectation_maximisation():
    rng = np.random.default_rng(4)
    votes = rng.choice([-1, 0, 1], p=[0.1, 0.15, 0.75], size=(150, 3))
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.estimate(patterns, counts.astype(float), ["a", "b", "c"], rounds=12, tolerance=0)
    assert np.allclose(model.posterior(votes), plain_estimate(votes, ["a", "b", "c"], 12))


def test_weak_rule_is_outvoted():
    """A rule that is right on 0.6 of the documents drops no good one; sharp rules still do their work."""
    rng = np.random.default_rng(7)
    kind = rng.choice(4, p=[0.85, 0.06, 0.05, 0.04], size=20_000)
    bad = np.array([[0.003, 0.003, 0.003], [0.98, 0.02, 0.02], [0.02, 0.98, 0.02], [0.02, 0.02, 0.98]])
    sharp = np.where(rng.random((len(kind), 3)) < bad[kind], 0, 1)
    weak = np.where(rng.random(len(kind)) < np.where(kind == 0, 0.4, 0.6), 0, 1)
    votes = np.c_[sharp, weak]
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality_rules.estimate(patterns, counts.astype(float), ["a", "b", "c", "weak"])
    kept = model.posterior(votes) >= 0.5
    lone = (sharp == 1).all(axis=1) & (weak == 0)
    assert kept[lone].all() and kept[kind == 0].mean() > 0.98 and (~kept[kind > 0]).mean() > 0.5
    assert model.accuracies()["weak"][0] < 0.9 < model.accuracies()["a"][0]


def brute_marginals(emission, transition):
    n = len(emission)
    total = np.zeros(n)
    z = 0.0
    for code in range(2**n):
        tags = [(code >> i) & 1 for i in range(n)]
        w = np.exp(sum(emission[i] for i in range(n) if tags[i]) + sum(transition[tags[i - 1], tags[i]] for i in range(1, n)))
        z += w
        total += w * np.array(tags)
    return total / z


def test_marginals():
    rng = np.random.default_rng(1)
    lengths = [1, 9, 2, 10, 1, 1, 8]
    doc = np.repeat(np.arange(len(lengths)), lengths)
    emission, transition = rng.normal(0, 2, len(doc)), rng.normal(0, 1, (2, 2))
    chance, pairs = toxicity.marginals(emission, transition, doc, pairs=True)
    for d in range(len(lengths)):
        assert np.allclose(chance[doc == d], brute_marginals(emission[doc == d], transition))
    assert pairs.sum() == pytest.approx(sum(n - 1 for n in lengths))
    # many texts, of very uneven lengths, against each alone
    doc = np.sort(rng.choice([0, 1, 2, 3, 4], p=[0.9, 0.05, 0.03, 0.01, 0.01], size=20_000))
    emission = rng.normal(0, 3, len(doc))
    whole, _ = toxicity.marginals(emission, transition, doc)
    assert np.allclose(whole, np.concatenate([toxicity.marginals(emission[doc == d], transition, doc[doc == d])[0] for d in range(5)]))


def test_toxicity(docs, labels, odd):
    model = toxicity.train(docs, labels)
    auc, right = accuracy(toxicity.classify(docs, model), labels, "toxic")
    assert auc > 0.85 and right > 0.9
    texts = [r["text"] for r in docs.limit(50).collect()]
    for text, spans in zip(texts, model.score(texts)[1]):
        _, _, _, chance = model.words([text])
        assert sum(len(re.findall(r"\w+", text[a:b])) for a, b in spans) == (chance > 0.5).sum()
    rows = toxicity.classify(odd, model).collect()
    assert len(rows) == len(ODD) + 2 and all(0 <= r["score"] <= 1 for r in rows) and not any(r["spans"] for r in rows if r["doc_id"] in (0, 1, 2))
    assert toxicity.classify(odd.limit(0), model).count() == 0
    assert toxicity.fit([], np.zeros(0, bool)).score(["a"])[0][0] < 0.5
    planted = ["the quiet word " * 20 + f"vile{k % 3}th here " for k in range(40)] + ["the quiet word " * 20 for _ in range(160)]
    own = toxicity.fit(planted, np.arange(200) < 40)
    score, spans = own.score(["a quiet vile1th word", "a quiet word"])
    assert score[0] > 0.5 > score[1] and spans == [[(8, 15)], []]


def test_mixing(spark, docs, labels, odd):
    targets = {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}
    labelled = mixing.labelled_languages(docs, labels)
    rows = mixing.mix_documents(docs, labelled, targets, stored).collect()
    assert len(rows) == docs.count()
    p, n, rate = (np.array([r[c] for r in rows]) for c in ("posteriors", "n_tokens", "rate"))
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert np.mean([list(targets)[k] == lang[r["doc_id"]] for r, k in zip(rows, p.argmax(axis=1))]) > 0.95
    assert (rate >= 0).all() and np.allclose((rate * n) @ p / n.sum(), list(targets.values()), atol=1e-4)
    assert [r["n_tokens"] for r in rows] == [len((t or "").split()) for t in [{d["doc_id"]: d["text"] for d in docs.collect()}[r["doc_id"]] for r in rows]]
    copies = np.array([r["copies"] for r in rows])
    assert (np.abs(copies - rate) < 1).all() and abs((copies * n).sum() / (rate * n).sum() - 1) < 0.1
    got = mixing.mix_documents(odd, labelled, targets, stored).collect()
    assert len(got) == len(ODD) + 2
    assert mixing.mix_documents(odd.limit(0), labelled, targets, stored).count() == 0


def dense_totals(p, n, wanted, rounds=60_000):
    """Totals of the least squares over rates >= 0, by plain projected gradient with one fixed small step."""
    a = p * n[:, None]
    rate, step = np.ones(len(n)), 1 / np.linalg.eigvalsh(a.T @ a).max()
    for _ in range(rounds):
        rate = np.maximum(0, rate + step * (a @ (wanted - rate @ a)))
    return rate @ a


def test_rates_are_the_projected_least_squares(spark):
    """Against a plain dense solver, with targets that force rates of 0, and with targets out of reach."""
    rng = np.random.default_rng(5)
    p = rng.dirichlet([0.6, 0.6, 0.6], 300)
    soft = 0.5 * p + 0.5 / 3  # no document has less than a sixth of a domain
    n = rng.integers(1, 900, 300)
    for shares, targets in ((p, [0.3, 0.3, 0.4]), (p, [0.96, 0.03, 0.01]), (soft, [0.96, 0.03, 0.01]), (soft, [0.0, 0.5, 0.5])):
        members = spark.createDataFrame(pa.table({"n_tokens": pa.array(n), "posteriors": pa.array(shares.tolist())}))
        wanted = np.array(targets) * n.sum()
        if shares is soft:
            with pytest.warns(UserWarning, match="out of reach"):
                fit = mixing.fit_rates(members, targets)
        else:
            fit = mixing.fit_rates(members, targets)
        rate = mixing.rates_of(shares, fit.steps)
        totals, best = (rate * n) @ shares, dense_totals(shares, n.astype(float), wanted)
        assert (rate >= 0).all() and np.allclose(totals, best, atol=2e-3 * n.sum()), (targets, totals, best)
        assert ((wanted - totals) ** 2).sum() <= 1.001 * ((wanted - best) ** 2).sum() + (1e-5 * n.sum()) ** 2
        assert fit.misfit == pytest.approx(np.abs(wanted - totals).max() / n.sum(), abs=1e-9)
        by_row = mixing.with_rates(members.withColumn("doc_id", F.monotonically_increasing_id()), fit.steps).orderBy("doc_id").collect()
        assert np.allclose([r["rate"] for r in by_row], rate)


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[700:1200] = x[0]  # a third of all rows alike
    rows = [(i, v.tolist(), "extra") for i, v in enumerate(x)]
    rows += [(2000, None, "e"), (2100, [0.0] * 16, "e"), (2200, [1.0, None] * 8, "e"), (2300, [float("nan")] * 16, "e"), (None, x[1].tolist(), "e"), (5, x[5].tolist(), "again")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = ann.search(vectors, F.col("id") % 50 == 0, k=10).collect()
    hits = total = 0
    for q in range(0, 1500, 50):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11)) and q not in [r["vec_id"] for r in mine]
        gap = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        assert [r["score"] for r in mine] == pytest.approx([gap[r["vec_id"]] for r in mine], abs=1e-12)
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        gap[q] = np.inf
        best = np.lexsort((np.arange(1500), gap))[:10]
        if q in (0, *range(700, 1200, 50)):
            assert [r["vec_id"] for r in mine] == best.tolist()  # ties go to the smaller id
        hits, total = hits + len(set(best) & {r["vec_id"] for r in mine}), total + 10
    assert len({r["query_id"] for r in got}) == 30 and hits / total >= 0.9
    few = spark.createDataFrame(rows[:4], vectors.schema)
    assert sorted((r["query_id"], r["rank"]) for r in ann.search(few, F.col("id") % 2 == 0, k=10).collect()) == [(q, r) for q in (0, 2) for r in (1, 2, 3)]
    assert ann.search(vectors.limit(0), F.col("id") % 2 == 0).count() == 0


def test_pipeline(spark, docs, labels, odd):
    """Each stage on all that its predecessor kept, against its operator's own verdicts."""
    rows = docs.withColumn("row", F.lit(1)).withColumn("stats", F.lit("x")).unionByName(odd.select("doc_id", "text", "row", "stats"), allowMissingColumns=True)
    sizes = []
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stored(stage(spark, rows, SF))
        assert kept.columns == rows.columns, name
        assert kept.exceptAll(rows).count() == 0, name  # rows go, none changes or is added
        sizes.append((rows.count(), kept.count()))
        rows = kept
    assert all(a > b > 0.5 * a for a, b in sizes)
    good = docs.join(labels.where("quality = 1"), "doc_id", "left_semi")
    assert corpus_pipeline.quality_classifier(spark, good, SF).count() > 0.98 * good.count()
    links = corpus_pipeline.ngram_join.near_copies(rows).where("n_links > 0").count()
    assert links == 0  # no near copies are left
    packed = corpus_pipeline.best_fit_packing(spark, rows, SF)
    assert packed.select("doc_id").distinct().count() == rows.select("doc_id").distinct().count()
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_neighbours_of_every_length_and_size(spark):
    """Lengths are searched each by itself; components whose squares overflow, or vanish, have their distances."""
    import math

    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=2 if i % 7 == 0 else 4)]) for i in range(80)]
    rows += [(i, [s * float(v) for v in rng.normal(size=4)]) for i, s in [*((i, 1e160) for i in range(80, 95)), *((i, 1e-170) for i in range(95, 110))]]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(vectors, F.col("id") % 5 == 0, k=6).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    for q, x in rows:
        if q % 5 == 0:
            near = sorted((math.dist(x, y), i) for i, y in rows if i != q and len(y) == len(x))[:6]
            mine = [(i, s) for _, i, s in sorted(got[q])]
            assert [s for _, s in mine] == pytest.approx([d for d, _ in near], rel=1e-12), q
            assert len({i for i, _ in mine}) == 6


def members_of(spark, shares, peak, n=4000, seed=1):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(n, 4)) + peak * np.eye(4)[rng.choice(4, p=shares, size=n)]
    p, tokens = mixing.softmax(z), rng.integers(50, 900, n)
    rows = pa.table({"doc_id": pa.array(np.arange(n)), "n_tokens": pa.array(tokens), "posteriors": pa.array(p.tolist())})
    return stored(spark.createDataFrame(rows)), p, tokens


def test_rates_reach_skewed_targets(spark):
    """Documents of the dominant domain are clipped to 0 on the way, and the targets are met all the same."""
    members, p, n = members_of(spark, [0.1, 0.1, 0.1, 0.7], 2.5)
    targets = np.array([0.5, 0.2, 0.2, 0.1])
    for total, scale in ((None, 1), (2.0 * n.sum(), 2)):
        fit = mixing.fit_rates(members, list(targets), total=total)
        rate = mixing.rates_of(p, fit.steps)
        assert fit.misfit <= mixing.TOLERANCE and (rate == 0).any() and fit.kept == pytest.approx(scale, abs=1e-3)
        assert np.abs((rate * n) @ p / n.sum() / scale - targets).max() <= mixing.TOLERANCE
    same = spark.createDataFrame(pa.table({"n_tokens": pa.array([3, 5]), "posteriors": pa.array([[0.25] * 4] * 2)}))
    with pytest.warns(UserWarning, match="out of reach"):
        assert mixing.fit_rates(same, list(targets)).misfit == pytest.approx(0.25, abs=1e-6)


def test_thinning_keeps_the_scarce_domains(spark):
    """With soft posteriors too, only domains with too much lose documents, and more is kept than by rates scaled to 1 for a pure document."""
    members, p, n = members_of(spark, [0.7, 0.15, 0.13, 0.02], 5.0)
    targets = np.array(list(corpus_pipeline.TARGETS.values()))
    fit = mixing.fit_rates(members, list(targets), largest=1.0)
    rows = mixing.with_rates(members, fit.steps, largest=1.0).orderBy("doc_id").collect()
    rate = np.array([r["rate"] for r in rows])
    taken = (rate * n) @ p
    assert np.allclose(taken / taken.sum(), targets, atol=1e-4) and fit.kept == pytest.approx((rate * n).sum() / n.sum())
    scarce = np.argmin(n @ p / n.sum() / targets)
    assert {r["copies"] for r in rows} <= {0, 1} and (rate[p[:, scarce] > 0.9] == 1).all()
    scaled = mixing.rates_of(p, mixing.fit_rates(members, list(targets)).steps)
    pure = mixing.rates_of(np.eye(4), mixing.fit_rates(members, list(targets)).steps).max()
    assert fit.kept > 1.1 * (scaled * n).sum() / pure / n.sum()
