"""Splittable quoted files, sorted sinks, brands over unions of words, and the enriched product view."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from medlink.operators import search as R
from medlink.sources import readers, writers
from medlink.sources.quoted import ends_inside


@pytest.fixture
def small_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, "4000")
    yield
    spark.conf.set(key, before)


def quoted_rows(n, signs):
    rng = random.Random(n)
    odd = ["", "plain", 'say "x"', "a\nb", '"\n"', "a,b\n\n" * 5, "x" * 900, "line\n" * 1700, '\n' * 9, "1\r\n2", signs]
    return [[str(i), *(rng.choice(odd) for _ in range(3))] for i in range(n)]


@pytest.mark.parametrize("encoding, signs", [("UTF-8", "藥膠囊é"), ("MS950", "藥膠囊功許蓋")])
def test_quoted_breaks_across_splits(spark, tmp_path, small_splits, encoding, signs):
    """A file of many small splits, with fields longer than a split, reads as the csv module reads it."""
    header, rows = ["id", "a", "b", "c d"], quoted_rows(120, signs)
    for name, some in (("one", rows[:80]), ("two", rows[80:])):
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([header, *some])
        (tmp_path / f"{name}.csv").write_bytes(out.getvalue().encode("cp950" if encoding == "MS950" else encoding))
    df = readers.read_delimited(spark, [f"{tmp_path}/one.csv", f"{tmp_path}/two.csv"], encoding=encoding)
    assert df.columns == header
    assert sorted(map(list, df.collect()), key=lambda r: int(r[0])) == rows
    lines = spark.read.text(f"{tmp_path}/one.csv")
    assert lines.rdd.getNumPartitions() > 10


def test_quotes_inside_fields_open_nothing(spark, tmp_path, small_splits):
    text = 'id|name|rest\n1|5" tab|x\n\n2|"a ""b""|c"|\n3|d"e\n4|"open\n5|x'
    (tmp_path / "f.txt").write_text(text)
    got = sorted(map(tuple, readers.read_delimited(spark, f"{tmp_path}/f.txt").collect()))
    assert got == [("1", '5" tab', "x"), ("2", 'a "b"|c', ""), ("3", 'd"e', ""), ("4", "open\n5|x", "")]
    assert readers.read_delimited(spark, f"{tmp_path}/f.txt", sep=",").columns == ["id|name|rest"]


@pytest.mark.parametrize(
    "line, outside, inside",
    [("a,b", False, True), ('"a', True, False), ('a"b', False, False), ('"a""b",c', False, False), ('x","y', True, True), ('"",""', False, True), ("", False, True), ('""', False, True)],
)
def test_how_lines_end(line, outside, inside):
    assert (ends_inside(line, False, ","), ends_inside(line, True, ",")) == (outside, inside)


def test_sorted_files_follow_each_other(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "SORTED_FILE_ROWS", 100)
    rows = [(None if i % 50 == 0 else (i * 7919) % 1000, f"n{i}") for i in range(750)]
    df = spark.createDataFrame(rows, "k int, name string").repartition(5)
    for _ in range(2):  # a repeated run replaces the files
        assert writers.write_sorted(df, f"{tmp_path}/t", ["k", "name"], "csv", header=False) == 8
    files = sorted((tmp_path / "t").glob("part-*.csv"))
    read = [tuple(r) for f in files for r in csv.reader(f.open())]
    assert len(files) > 1 and read == [("" if k is None else str(k), n) for k, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert writers.write_sorted(df.limit(0), f"{tmp_path}/e", ["k"]) == 1 and spark.read.parquet(f"{tmp_path}/e").count() == 0


def test_brands_over_unions_of_words(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"W{i}" for i in range(12)] + ["HOT"] * 12
    items = [(" ".join(rng.choices(words, k=3)), rng.choice(["g1", "g2", None]), rng.choice([None, *(f"b{i}" for i in range(60))])) for _ in range(600)]
    queries = ["hot w1", "w1 w2 w3", "hot", "w", "w1", "HOT w99", "w98 w99", "", "hot hot w5"]
    for limit in (1, 8, 10**6):
        monkeypatch.setattr(R, "BITMAP_BRANDS", limit)
        got = R.grouped_search(
            spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame(items, "n string, grp string, brand string"), "q", "n", ["grp"], "brand"
        ).collect()
        want = {}
        for query in queries:
            asked = query.upper().split()
            for name, grp, brand in items:
                if set(asked) & set(name.split()) or (len(asked) == 1 and name.split()[0].startswith(asked[0])):
                    want.setdefault((query, grp), set()).update({brand} - {None})
        found = {(r["query"], r["grp"]): r["brand_count"] for r in got}
        assert {k: v for k, v in found.items() if v} == {k: len(v) for k, v in want.items() if v}, limit


def test_enriched_products(spark):
    one = spark.createDataFrame
    products = one([("P1", "A1"), ("P2", None), ("P3", "ZZ")], "product_code string, atc_code string")
    owned = one(
        [("P1", "i2", "active", "nhi"), ("P1", "i1", "active", "tfda"), ("P1", "i1", "excipient", "nhi"), ("P2", "i9", "active", "nhi")],
        "product_code string, ingredient_id string, role string, source string",
    ).withColumns({"strength_value": F.lit(None).cast("decimal(18,6)"), "strength_unit": F.lit(None).cast("string")})
    concepts = one([("i1", "ALPHA"), ("i2", "BETA")], "ingredient_id string, canonical_name string")
    links = one([("P1", f"L{i}", "suffix") for i in (3, 1, 2)] + [("P2", "gone", "suffix")], "product_code string, permit_no string, link_source string")
    permits = one([(f"L{i}", "n", "d", "t", False) for i in (1, 2, 3)], "permit_no string, product_name string, dosage_form string, ingredient_text string, is_cancelled boolean")
    atc = one([("A1", "name")], "atc_code string, atc_name string")
    variants = one([("product", "P1", "en", "product_name_en", "b"), ("product", "P1", "zh", "product_name_zh", "a"), ("ingredient", "P1", "en", "x", "no")], "target_type string, target_id string, language string, variant_type string, variant_text string")
    rows = R.enriched_products(products, owned, concepts, links, permits, atc, variants, chunk=2).orderBy("product_code", "chunk_no").collect()
    assert [(r["product_code"], r["chunk_no"], r["atc_name"]) for r in rows] == [("P1", 0, "name"), ("P1", 1, "name"), ("P2", 0, None), ("P3", 0, None)]
    assert [(x["canonical_name"], x["source"]) for r in rows[:2] for x in r["ingredients"]] == [("ALPHA", "nhi"), ("ALPHA", "tfda"), ("BETA", "nhi")]
    assert rows[0]["ingredient_names"] == ["ALPHA", "BETA"] and rows[1]["ingredient_names"] is None
    assert [x["permit_no"] for r in rows[:2] for x in r["permits"]] == ["L1", "L2", "L3"]
    assert [(x["text"], x["language"], x["type"]) for x in rows[0]["variants"]] == [("b", "en", "product_name_en"), ("a", "zh", "product_name_zh")]
    assert all(rows[3][c] is None for c in ("ingredients", "permits", "variants"))
    assert R.active_ingredients(owned).where("product_code = 'P1'").count() == 2
