"""Exact deduplication, integer clustering and the Merkle manifest against plain versions and on odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from medlink.llm import centroids, exact_dedup, merkle

WIDE = "doc_id long, text string, lang string, source string, n_chars long, rep long, row long, n long, digest string, idx int, tree string, path string"


def wide(spark, rows):
    """Rows (doc_id, text, lang, source, n_chars) with more columns, named as the operators' own."""
    return spark.createDataFrame([(*r, 1, 2, 3, "d", 4, "t", "p") for r in rows], WIDE)


def nulls_first(row):
    return tuple((x is not None, x if x is not None else 0) for x in row)


def collected(df):
    return sorted(map(tuple, df.collect()), key=nulls_first)


LONG = "ab \n" * 300_000
TEXTS = ["a b", "a  b", "a\t\r\nb", " a b", "", None, " ", "\n", "a b", LONG, LONG.replace("\n", "\t"), "é", "é", "x" * 5000, "x" * 4999]


def plain_dedup(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda i: (i is None, i or 0))
        sha = hashlib.sha256(text.encode()).hexdigest()
        out += [(i, ids[0], len(ids), at == 0, sha) for at, i in enumerate(ids)]
    return sorted(out, key=nulls_first)


@pytest.mark.parametrize("table_bytes", [64 << 20, 6000])
@pytest.mark.parametrize("hashed", [exact_dedup.hash_of, lambda digest: F.lit(5).cast("long")], ids=["digest", "all equal"])
def test_exact_dedup(spark, table_bytes, hashed):
    """Small tables spill, level by level; equal hashes fill one bucket, and contents alone decide."""
    rng = random.Random(3)
    ids, texts = [None, 4, 4, *range(100, 140)], [t for t in TEXTS if table_bytes > 6000 or t is None or len(t) <= 5000]
    rows = [(rng.choice(ids), rng.choice(texts)) for _ in range(60)] + [(7, "hot copy")] * 40 + [(i, "hot  copy") for i in range(50, 90)]
    df = wide(spark, [(i, t, None, None, None) for i, t in rows]).coalesce(2)
    assert collected(exact_dedup.dedup(df, table_bytes=table_bytes, hashed=hashed)) == plain_dedup(rows)


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.dedup(wide(spark, [])).collect() == []


def test_content_table():
    table = exact_dedup.ContentTable(100)
    contents = [bytes([i]) * 4 for i in range(30)]
    assert [table.find_or_add(i % 2, c) for i, c in enumerate(contents)] == [*range(25), *[-1] * 5]
    assert [table.find_or_add(i % 2, c) for i, c in enumerate(contents)] == [*range(25), *[-1] * 5]
    assert table.find_or_add(1, contents[0]) == -1  # another hash is another content
    table.clear()
    assert table.find_or_add(0, b"y" * 200) == 0  # longer than the table: alone in it
    assert table.find_or_add(0, b"z") == -1 and table.find_or_add(0, b"y" * 200) == 0
    table = exact_dedup.ContentTable(1 << 30)
    many = [str(i).encode() for i in range(5000)]
    assert [table.find_or_add(7, m) for m in many[:700]] == [*range(700)]
    assert [table.find_or_add(hash(m) & 0xFFFFFF, m) for m in many] == [*range(700, 5700)]


def plain_clusters(rows, k, rounds, dims, scale=256):
    def sha(text):
        return hashlib.sha256(text.encode()).hexdigest()

    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    centres = [v for _, v in sorted((sha(f"2:{'' if i is None else i}"), v) for i, v in kept)[:k]]

    def assign():
        gaps = [[sum((a - b) ** 2 for a, b in zip(v, m)) for m in centres] for _, v in kept]
        return [(g.index(min(g)), min(g)) for g in gaps]

    for _ in range(rounds):
        of = assign()
        for j in range(len(centres)):
            members = [v for (c, _), (_, v) in zip(of, kept) if c == j]
            centres[j] = [sum(x) // len(members) for x in zip(*members)] if members else centres[j]
    of, inertia = assign(), defaultdict(int)
    for c, d in of:
        inertia[c] += d
    shas = [sha(",".join(map(str, m))) for m in centres]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), shas[c]) for (c, d), (i, _) in zip(of, kept)), key=nulls_first)


@pytest.mark.parametrize("n, block_dims", [(300, 4), (300, 64), (3, 2), (0, 2)])
def test_clusters(spark, n, block_dims):
    rng = random.Random(n)
    values = [0.0, 1.5, -700.2501, 400000.0, 0.001]
    rows = [(rng.choice([None, *range(40)]), [rng.choice(values) for _ in range(rng.choice([6, 6, 6, 5]))]) for _ in range(n)]
    odd = [(7, None), (8, []), (9, [math.nan] * 6), (9, [math.inf] * 6), (9, [None] * 6)] if n else []
    df = spark.createDataFrame([(i, v, 0, 0, "c") for i, v in rows + odd], "vec_id long, embedding array<double>, block int, cluster int, chunk string")
    got = centroids.cluster(df.repartition(4), k=12, dims=6, block_dims=block_dims)
    assert collected(got) == plain_clusters(rows, 12, 5, 6)


def test_components_without_a_long_distance_raise(spark):
    df = spark.createDataFrame([(1, [1e160, 0.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="magnitude"):
        centroids.cluster(df, k=2, dims=2).collect()


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(rows):
    def leaf(doc_id, text, lang, source, n_chars):
        values = (doc_id, source, lang, n_chars, text)
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([H(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
        return out

    by_lang = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        base = changed = leaf(doc_id, text, lang, source, n_chars)
        if doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0:
            changed = leaf(doc_id, text, lang, source, n_chars + 1)
        by_lang[lang].append((doc_id, base, changed))
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=nulls_first)
        trees[lang] = levels([x[1] for x in by_lang[lang]])
    forest = levels([trees[x][-1][0] for x in langs])
    out = []
    for number, lang in enumerate(langs):
        for place, (doc_id, base, changed) in enumerate(by_lang[lang]):
            siblings, digest = [], changed
            for tree, at in ((trees[lang], place), (forest, number)):
                for level in tree[:-1]:
                    other = level[at ^ 1 : (at ^ 1) + 1]
                    siblings += other
                    digest = H(*other, digest) if at % 2 else H(digest, *other)
                    at //= 2
            out.append((doc_id, base, trees[lang][-1][0], forest[-1][0], H(*siblings), digest, digest == forest[-1][0]))
    return sorted(out, key=nulls_first)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("n, langs, bits", [(200, ["en", None, "", "ü", "z"], 2), (65, ["en"], 3), (8, ["en", "de"], 1), (1, [None], 10), (0, ["en"], 2), (90, [str(i) for i in range(40)], 2)])
def test_manifest(spark, n, langs, bits):
    rng = random.Random(n)
    rows = [
        (rng.choice([None, 14, *range(500)]), rng.choice([None, "", "text é", "b"]), rng.choice(langs), rng.choice([None, "s"]), rng.choice([None, -1, 5]))
        for _ in range(n)
    ]
    rows += rows[:2] * 3
    got = merkle.manifest(wide(spark, rows).repartition(3), bits=bits).select(*COLUMNS)
    assert collected(got) == plain_manifest(rows)


def test_hot_language_is_numbered_over_ranges(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 20)
    rows = [(5, "same", "en", "s", 4)] * 70 + [(i, "t", "en", "s", 1) for i in range(60)] + [(1, "t", None, "s", 1)]
    assert collected(merkle.manifest(wide(spark, rows), bits=3).select(*COLUMNS)) == plain_manifest(rows)


def test_versions_share_what_they_do_not_copy(spark):
    rows = [(i, "t", "en", "s", i) for i in range(300)]
    made = merkle.manifest(wide(spark, rows), bits=4).where("tampered_leaf is not null").collect()
    assert {len(r["copied"]) for r in made} == {9}  # ancestors only: 300 leaves have 9 levels above them
    assert not any(r["verified"] for r in made)
    clean = {r["root"] for r in made}
    assert len(clean) == 1 and len({r["folded_root"] for r in made}) == len(made)
