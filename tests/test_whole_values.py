"""Registered queries return whole values where the test tables alone would not show a cut."""

from pyspark.sql import functions as F

from __spark_entry__ import queries
from medlink.catalog.case_queries import whole_details
from medlink.operators.search import product_details


def test_directions_and_indications_of_the_document(spark, tmp_path):
    spark.createDataFrame([(1, "用法：睡前\n用途：發燒"), (3, "用法：睡前")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for name, want in (
        ("case_fields", {1: ("每日一次, 睡前", "止痛, 發燒"), 3: ("每日一次, 睡前", "止痛")}),
        ("stored_fields", {1: ("飯後, 睡前", "頭痛, 發燒"), 3: ("from response", "pain")}),
    ):
        rows = queries()[name](spark, str(tmp_path)).collect()
        assert {r["doc_id"]: (r["directions"], r["first_indication"]) for r in rows} == want


def test_permits_of_every_chunk(spark):
    products = spark.createDataFrame([("P1", "a", "b", "A"), ("P2", "c", "d", "A")], "product_code string, name_en string, name_zh string, atc_code string")
    owned = spark.createDataFrame([("P1", "i", "active", "item", None, None)], "product_code string, ingredient_id string, role string, source string, strength_value string, strength_unit string")
    concepts = spark.createDataFrame([("i", "plate")], "ingredient_id string, canonical_name string")
    links = spark.range(2500).select(F.lit("P1").alias("product_code"), F.format_string("N%04d", "id").alias("permit_no"))
    permits = links.select("permit_no", *[F.lit(None).cast("string").alias(c) for c in ("product_name", "dosage_form", "ingredient_text")], F.lit(False).alias("is_cancelled"))
    detail = product_details(products, owned, concepts, links, permits, spark.createDataFrame([("A", "ATC A")], "atc_code string, atc_name string"))
    lists = detail["ingredients"].select("product_code", "chunk_no", F.lit("plate").alias("ingredients"))
    rows = whole_details(detail["products"], lists, detail["permits"]).collect()
    assert {r["product_code"]: r["permits"] for r in rows if r["product_code"] == "P2"} == {"P2": None}
    mine = sorted((r for r in rows if r["product_code"] == "P1"), key=lambda r: r["chunk_no"])
    assert [(r["chunk_no"], r["ingredients"]) for r in mine] == [(0, "plate"), (1, None), (2, None)]
    assert "|".join(r["permits"] for r in mine).split("|") == [f"N{i:04d}" for i in range(2500)]
