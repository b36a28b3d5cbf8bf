"""Curated build, matching, interactions, lists, sources, sinks and streaming on small fixtures."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from medlink.functions import ingredients as I
from medlink.functions import text as T
from medlink.operators import cases as G
from medlink.operators import curate as C
from medlink.operators import interactions as D
from medlink.operators import keyed as K
from medlink.operators import lists as P
from medlink.operators import matching as M
from medlink.plans.case_flow import case_flow
from medlink.plans.curated import curated_build, quality_report
from medlink.sources import readers as S
from medlink.sources import writers as W

PERMIT = (
    "permit_no string, cancel_status string, cancel_date date, expiry_date date, issue_date date, controlled_substance_level string, "
    "product_name_zh string, product_name_en string, dosage_form string, packaging string, ingredient_text string, applicant_name string, "
    "applicant_address string, applicant_tax_id string, manufacturer_name string, manufacturer_site_address string, "
    "manufacturer_company_address string, manufacturer_country string"
)
ITEM = (
    "product_code string, name_zh string, name_en string, ingredient_text string, dose_form string, combo_flag string, atc_code string, "
    "permit_link string, effective_start date, effective_end date"
)
ATC = "atc_code string, atc_name string, ddd double, uom string, adm_r string, note string, snapshot_date date"


def permit(no, text, en="x"):
    return (no, "未註銷", None, None, None, None, "", en, "tab", None, text, None, None, None, None, "site", "", "TW")


def build(spark, items, permits, **options):
    atc = [("N02BE01", "OLD", 2.0, "g", "O", None, dt.date(2025, 1, 1)), ("N02BE01", "NEW", 3.0, "g", "O", None, dt.date(2026, 1, 1))]
    return curated_build(
        spark.createDataFrame(items, ITEM), spark.createDataFrame(permits, PERMIT), spark.createDataFrame(permits[:1], PERMIT),
        spark.createDataFrame(atc, ATC), "2026-01-01", **options,
    )


@pytest.fixture(scope="module")
def tables(spark):
    d = dt.date
    items = [
        ("A1", "舊", "OLD DRUG", "Acetaminophen", "tab", "單方", "N02BE01", "http://x/?permitNo=P000001", d(2023, 1, 1), d(2023, 12, 31)),
        ("A1", "新", "NEW DRUG", "Acetaminophen", "tab", "單方", "N02BE01", "http://x/?permitNo=P000001", d(2024, 1, 1), None),
        ("B1", None, "COMBO DRUG", "Aspirin + Caffeine", "tab", "複方", "ZZZ", "http://x/?licId=99000002", d(2024, 2, 1), None),
        ("C1", None, "ODD DRUG", "Ibuprofen 200 mg", "tab", "單方", None, "http://x/?permitNo=P000001", d(2024, 2, 1), None),
    ]
    return build(spark, items, [permit("P000001", "ACETAMINOPHEN"), permit("P000002", "CAFFEINE;;ASPIRIN")])


def test_curated_build(tables):
    products = {r["product_code"]: r for r in tables["products"].collect()}
    assert products["A1"]["name_en"] == "NEW DRUG" and products["B1"]["is_combo"] and len(products) == 3
    assert {(r["product_code"], r["permit_no"]) for r in tables["links"].collect()} == {("A1", "P000001"), ("B1", "P000002"), ("C1", "P000001")}
    reviews = tables["reviews"].collect()
    assert [r["product_code"] for r in reviews] == ["C1"]
    assert reviews[0]["confidence"] == 0.0 and len(reviews[0]["candidate_ingredient_ids"]) == 2
    assert [r["atc_name"] for r in tables["atc"].collect()] == ["NEW"]
    names = {r["canonical_name_normalized"] for r in tables["concepts"].collect()}
    assert {"ACETAMINOPHEN", "ASPIRIN", "CAFFEINE", "IBUPROFEN 200 MG", "IBUPROFEN"} == names
    tokens = {(r["token"], r["token_stem"]) for r in tables["ingredient_tokens"].collect()}
    assert ("IBUPROFEN", "IBUPROFEN") in tokens


def test_quality_report(spark, tables):
    codes = spark.createDataFrame([("A1",), ("X9",)], "product_code string")
    row = quality_report(tables, codes)["summary"].first().asDict()
    assert row["products"] == 3 and row["with_atc_pct"] == "66.67%" and row["with_known_atc_pct"] == "33.33%"
    assert row["overlap"] == 1 and row["code_set_only"] == 1 and row["review_items"] == 1


def test_review_rules_and_rerun(spark):
    def pairs(*rows):
        return spark.createDataFrame([(f"p{i}", "L", a, b) for i, (a, b) in enumerate(rows)], "product_code string, permit_no string, item_text string, permit_text string")

    quiet = pairs(
        ("Acetaminophen 500 mg", "ACETAMINOPHEN"), ("A + B", "B;;A"), ("X (EQ TO Y)", "X"), ("DL-METHIONINE", "METHIONINE"),
        ("CHLORPROMAZINE HCL", "CHLORPROMAZINE (HCL)"), ("ETILEFRIN", "ETHYLPHENYLEPHRINE"), ("", "A"),
    )
    assert C.mismatch_items(quiet).count() <= 1
    loud = pairs(("Acetaminophen", "Ibuprofen"), ("A", "A;;B"))
    first, second = C.mismatch_items(loud, 0.8).collect(), C.mismatch_items(loud, 0.8).collect()
    assert len(first) == 2 and {r["review_id"] for r in first} == {r["review_id"] for r in second}


def dictionary(spark):
    products = spark.createDataFrame(
        [
            ("BC1", "TRAJENTA DUO 2.5/850MG", "糖倍平膜衣錠2.5/850毫克", dt.date(2024, 1, 1)), ("BC2", "LINAGLIPTIN METFORMIN TAB", None, dt.date(2023, 1, 1)),
            ("BC3", "SPIRIVA RESPIMAT", "適喘樂", dt.date(2022, 1, 1)),
        ],
        "product_code string, name_en string, name_zh string, effective_start date",
    )
    mentions = spark.createDataFrame(
        [("BC1", "LINAGLIPTIN"), ("BC1", "METFORMIN HCL"), ("BC2", "LINAGLIPTIN"), ("BC2", "METFORMIN HCL"), ("BC3", "TIOTROPIUM BROMIDE"),
         ("Z1", "OMEPRAZOLE"), ("Z2", "SENNOSIDE"), ("Z3", "ACARBOSE"), ("Z4", "LEVOCETIRIZINE"), ("Z5", "AMOXICILLIN"), ("Z6", "BENPROPERINE")],
        "product_code string, mention string",
    ).withColumn("source", F.lit("nhi"))
    aliases = spark.createDataFrame([("TIOTROPIUM BROMIDE", "tiotropium")], "mention string, variant_text string").select(
        F.lit("ingredient").alias("target_type"), C.mention_id("mention").alias("target_id"), "variant_text", T.normalize_text("variant_text").alias("normalized_text")
    )
    own = C.name_variants(products, mentions.limit(0)).select("target_type", "target_id", "variant_text", "normalized_text")
    return M.Dictionary(products, C.build_concepts(mentions), C.product_ingredients(mentions), own.unionByName(aliases))


GOLDEN = {
    "OMEPRAZOLE": ("canonical_exact", 0.95),
    "Omeprazole 20mg": ("ingredient_token", 0.65),
    "Sennosides 12mg": ("ingredient_token", 0.65),
    "Acarbose 50mg": ("ingredient_token", 0.65),
    "60puff/bot(tiotropium)": ("paren_alias_exact", 0.85),
    "Linagliptin & Metformin 850mg": ("ingredient_token", 0.65),
    "糖倍平 膜衣錠 2.5/850 毫克": ("cjk_fuzzy", 0.85),
    "Spiriva Respi mat 60puff 2.5mcg": ("product_token_contain", 0.80),
    "LEVOCETIRIZINE XYZ": ("ingredient_token", 0.65),
    "Xyzalol 999mg": (None, None),
}


def line_rows(spark):
    return spark.createDataFrame([(1, i, t) for i, t in enumerate(GOLDEN)] + [(2, 0, "OMEPRAZOLE")], "case_id long, input_index int, input_text string")


def test_match_lines(spark):
    got = M.match_lines(line_rows(spark), dictionary(spark).materialised())
    found = {r["input_text"]: (r["match_method"], r["confidence"]) for r in got.collect()}
    assert found["OMEPRAZOLE"] == GOLDEN["OMEPRAZOLE"] and found["Xyzalol 999mg"] == (None, None)
    for text in ("Omeprazole 20mg", "Sennosides 12mg", "Acarbose 50mg", "60puff/bot(tiotropium)", "LEVOCETIRIZINE XYZ"):
        assert found[text] == GOLDEN[text], text
    assert found["Linagliptin & Metformin 850mg"][0] in ("ingredient_token", "product_token_contain")
    assert found["糖倍平 膜衣錠 2.5/850 毫克"][0] in ("product_exact", "ocr_product", "cjk_fuzzy")
    assert got.where("case_id = 2").count() == 1
    rows = got.groupBy("case_id", "input_index", "ingredient_id").count().where("count > 1").count()
    assert rows == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_strict_clean_repairs_spelling(spark):
    d = dictionary(spark)
    texts = spark.createDataFrame([("AMOXYCILLIN (T CUR33",), ("十全BENPROPERI NOR",)], "input_text string")
    names = {r["input_text"]: r["canonical_name"] for r in M.strict_clean_hits(texts, d).join(d.concepts, "ingredient_id").collect()}
    assert names["十全BENPROPERI NOR"] == "BENPROPERINE"


def test_case_flow(spark):
    d = dictionary(spark)
    cases = spark.createDataFrame([("c1", "OMEPRAZOLE\nAcarbose &\n50mg"), ("c2", "nothing here\nzz")], "case_id string, ocr_raw_text string")
    ids = {r["canonical_name"]: r["ingredient_id"] for r in d.concepts.collect()}
    a, b = sorted((ids["OMEPRAZOLE"], ids["ACARBOSE"]))
    pairs = spark.createDataFrame([(a, b, "major")], "ingredient_a string, ingredient_b string, severity string")
    out = case_flow(cases, d, pairs, D.severity_templates(spark))
    items = {(r["case_id"], r["display_name"]): r["match_status"] for r in out["items"].collect()}
    assert items == {("c1", "OMEPRAZOLE"): "matched", ("c1", "ACARBOSE"): "matched", ("c2", "nothing here"): "unmatched"}
    assert [(r["case_id"], r["severity"]) for r in out["interactions"].collect()] == [("c1", "major")]


def test_detected_items_fallbacks(spark):
    schema = "case_id long, input_index int, input_text string, match_status string, match_method string, confidence double, product_id string, product_name string, ingredient_id string, display_name string"
    rows = [(1, 0, "short", "unmatched", None, None, None, None, None, None), (1, 1, "longest line", "unmatched", None, None, None, None, None, None),
            (2, 0, "a", "matched", "m", 0.9, None, None, "I1", "One"), (2, 1, "b", "matched", "m", 0.8, None, None, "I1", "One again"), (2, 2, "zzz", "unmatched", None, None, None, None, None, None)]
    matches = spark.createDataFrame(rows, schema)
    got = {(r["case_id"], r["display_name"]) for r in G.detected_items(matches).collect()}
    assert got == {(1, "longest line"), (2, "One")}
    names = spark.createDataFrame([(1, "Given"), (2, "Ignored")], "case_id long, medication_name string")
    assert {(r["case_id"], r["display_name"]) for r in G.detected_items(matches, medication_names=names).collect()} == {(1, "Given"), (2, "One")}
    brands = spark.createDataFrame([(1, 0, "short", "matched", "P", "Brand", "product_exact", 0.95)], "case_id long, input_index int, input_text string, match_status string, product_id string, product_name string, match_method string, confidence double")
    owned = spark.createDataFrame([("P", "I7")], "product_code string, ingredient_id string")
    assert {(r["case_id"], r["display_name"]) for r in G.detected_items(matches, brands, owned).collect()} == {(1, "Brand"), (2, "One")}


def test_pair_fold_and_names(spark):
    names = spark.createDataFrame([("Alpha", "1", "exact"), ("Beta", "0", "exact"), ("Lost", None, "unmapped")], "drug_name string, ingredient_id string, match_method string")
    pairs = spark.createDataFrame(
        [("Alpha", "Beta", "Minor", "file_b.csv", "1"), ("Beta", "Alpha", "Major", "file_a.csv", "2"), ("Alpha", "Lost", "weird", "x", "1")],
        "drug_a string, drug_b string, severity string, sources string, raw_rows string",
    )
    row = D.import_pairs(pairs, names).collect()
    assert [tuple(r[c] for c in ("ingredient_a", "ingredient_b", "severity", "sources", "raw_rows")) for r in row] == [("0", "1", "major", "file_a.csv;file_b.csv", 3)]
    once = D.import_pairs(pairs, names, D.import_pairs(pairs, names)).first()
    twice = D.import_pairs(pairs, names, D.import_pairs(pairs, names), merge_existing=True).first()
    assert once["raw_rows"] == 3 and twice["raw_rows"] == 6


def test_case_evaluation(spark):
    codes = spark.createDataFrame([(1, "N999", 0), (1, "N2", 1), (1, "N1", 2)], "case_id int, product_code string, position int")
    owned = spark.createDataFrame([("N1", "a"), ("N2", "b")], "product_code string, ingredient_id string")
    concepts = spark.createDataFrame([("a", "A"), ("b", "B")], "ingredient_id string, canonical_name string")
    pairs = spark.createDataFrame([("a", "b", "major")], "ingredient_a string, ingredient_b string, severity string")
    none = spark.createDataFrame([], "case_id int, ingredient_id string")
    texts = spark.createDataFrame([(2, "something")], "case_id int, raw_text string")
    out = D.evaluate_cases(codes, none, texts, owned, concepts, pairs)
    counts = {r["case_id"]: (r["checked_count"], r["unchecked_count"], r["interaction_count"], r["state"]) for r in out["counts"].collect()}
    assert counts == {1: (2, 1, 1, "interactions"), 2: (0, 1, 0, "incomplete")}


def test_equal_positions_name_the_smaller_code(spark):
    """Several products of a case at one position: the answer doesn't depend on the order of rows."""
    codes = [("k1", c, 3) for c in ("P9", "P10", "P2")] + [("k1", "P1", 4), ("k2", "P9", 1)]
    owned = spark.createDataFrame([(c, "i1") for c in ("P9", "P10", "P2", "P1")], "product_code string, ingredient_id string")
    ids = spark.createDataFrame([("k1", "i1"), ("k2", "i2"), ("k3", "i1")], "case_id string, ingredient_id string")
    texts = spark.createDataFrame([], "case_id string, raw_text string")
    concepts = spark.createDataFrame([], "ingredient_id string, canonical_name string")
    pairs = spark.createDataFrame([], "ingredient_a string, ingredient_b string, severity string")
    for rows in (codes, codes[::-1]):
        df = spark.createDataFrame(rows, "case_id string, product_code string, position int").coalesce(1)
        got = D.evaluate_cases(df, ids, texts, owned, concepts, pairs)["unchecked"].collect()
        assert {(r["case_id"], r["raw_text"], r["product_code"]) for r in got} == {("k1", "i1", "P10"), ("k2", "i1", "P9"), ("k2", "i2", None), ("k3", "i1", None)}


def test_name_prefix_and_base(spark):
    concepts = spark.createDataFrame([("1", "ASPIRIN"), ("2", "ASPIRIN 100 MG"), ("3", "ACARBOSE 50 MG")], "ingredient_id string, canonical_name string")
    names = spark.createDataFrame([("asp",), ("Acarbose 50",), ("zz",)], "name string")
    assert {(r[0], r[1]) for r in P.names_starting_with(names, concepts).collect()} == {("asp", "1"), ("asp", "2"), ("Acarbose 50", "3")}
    assert {r[0] for r in P.base_ingredients(concepts.select("ingredient_id"), concepts).collect()} == {"1", "3"}


def test_keyed_helpers(spark):
    big = spark.range(5000).select((F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50)).alias("k"), "id")
    placed = K.positions(big, ["k"], [F.col("id")], "p", F.floor(F.col("id") / 300))
    want = K.positions(big, ["k"], [F.col("id")], "p")
    assert placed.exceptAll(want).count() == 0
    lists = K.chunked_lists(want, ["k"], "p", F.col("id"), "ids", 100)
    assert lists.agg(F.max(F.size("ids")), F.sum(F.size("ids"))).first()[:] == (100, 5000)


def test_csv_and_registry(spark, tmp_path):
    header = [h for _, h, _ in S.V.ITEM_COLUMNS]
    values = dict.fromkeys(header, "") | {"藥品代號": " A1 ", "有效起日": "1130101", "支付價": "12.34", "成分": 'x, "y"'}
    line = ",".join('"' + values[h].replace('"', '""') + '"' for h in header)
    (tmp_path / "A21030000I-E41001-001.csv").write_text("﻿" + ",".join(header) + "\n" + line + "\n", encoding="utf-8")
    row = S.read_dataset(spark, "nhi_items", [str(tmp_path)]).first()
    assert row["product_code"] == "A1" and row["effective_start"] == dt.date(2024, 1, 1) and float(row["price"]) == 12.34
    assert row["effective_end"] is None and json.loads(row["source_payload"])["藥品代號"] == " A1 "
    assert S.read_dataset(spark, "nhi_component_map", [str(tmp_path)]).count() == 0
    with pytest.raises(FileNotFoundError):
        S.read_dataset(spark, "tfda_36", [str(tmp_path)])
    assert S.dataset_keys("all")[0] == "nhi_items"


def test_history_lines(spark):
    line = [" "] * 1820

    def put(at, text):
        line[at : at + len(text)] = text

    put(14, "1"), put(17, "A000133209"), put(32, "99.00"), put(38, "0840301"), put(46, "0890331")
    put(54, "PROLUTON DEPOT INJECTION 250 MG"), put(178, "1.00"), put(183, "ML"), put(236, "HYDROXYPROGESTERONE CAPROATE")
    put(298, "250 MG/ML"), put(330, "注射劑"), put(1808, "G03DA03")
    row = S.parse_history(spark.createDataFrame([("".join(line),)], "value string")).first()
    assert row["product_code"] == "A000133209" and float(row["price"]) == 99.0
    assert (row["effective_start"], row["effective_end"]) == (dt.date(1995, 3, 1), dt.date(2000, 3, 31))
    assert row["name_en"] == "PROLUTON DEPOT INJECTION 250 MG" and row["package_unit"] == "ML"
    assert row["ingredient_text"] == "HYDROXYPROGESTERONE CAPROATE" and row["dose_form"] == "注射劑" and row["atc_code"] == "G03DA03"


def test_quoted_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"two\nlines"\n2,"a ""quote"""\n', encoding="utf-8")
    rows = S.read_delimited(spark, f"{tmp_path}/a.csv").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("1", "two\nlines"), ("2", 'a "quote"')]


def test_pairs_in_sets_of_any_size(spark):
    rng = random.Random(4)
    sets = [(c, f"I{rng.randrange(40)}") for c in range(30) for _ in range(rng.randrange(1, 25))] + [(99, f"I{i}") for i in range(40)] + [(98, None)]
    pairs = {tuple(rng.sample([f"I{i}" for i in range(45)], 2)) for _ in range(200)}
    have = {c: {i for k, i in sets if k == c} for c, _ in sets}
    want = sorted((c, a, b, "major") for c, ids in have.items() for a, b in pairs if a in ids and b in ids)
    s = spark.createDataFrame(sets, "case_id int, ingredient_id string")
    p = spark.createDataFrame([(a, b, "major") for a, b in pairs], "ingredient_a string, ingredient_b string, severity string")
    for limit in (1, 8, 1000):
        got = D.pairs_in_sets(s, p, small_set=limit).select("case_id", "ingredient_a", "ingredient_b", "severity").collect()
        assert sorted(tuple(r) for r in got) == want


def test_long_lists_and_noise(spark):
    photos = spark.range(2500).select(F.lit(1).alias("case_id"), F.col("id").alias("photo_index"), F.concat(F.lit("t"), "id").alias("text"), F.lit(None).cast("string").alias("case_fields"))
    chunks = G.combine_photos(photos)["texts"].orderBy("chunk_no").collect()
    assert [r["chunk_no"] for r in chunks] == [0, 1, 2]
    assert "\n\n".join(r["text"] for r in chunks) == "\n\n".join(f"t{i}" for i in range(2500))
    lines = ["Use before 2027/01/01", "Side effects may include nausea", "ASPIRIN 100 MG", "藥品查詢 x"]
    noise = spark.createDataFrame([(x,) for x in lines], "t string").select(G.is_meta_noise("t").alias("n")).collect()
    assert [r["n"] for r in noise] == [True, True, False, True]


def test_many_aliases(spark):
    lookup = {f"NAME {i}": f"TARGET{i}" for i in range(1500)} | {"NAME 7 SODIUM": "SALT"}
    tokens = spark.createDataFrame([("NAME 7",), ("NAME 7 SODIUM X",), ("NAME 71",), ("OTHER",), ("",)], "token string")
    got = [r[0] for r in tokens.select(I.apply_alias("token", lookup)).collect()]
    assert got == ["TARGET7", "SALT X", "TARGET71", "OTHER", ""]


def test_sinks(spark, tmp_path):
    df = spark.range(100).select("id", (F.col("id") % 7).alias("v"))
    rows = W.write_batch(df, f"{tmp_path}/raw", f"{tmp_path}/batches", "b1", "src", "v1", "2026-01-01")
    back = spark.read.parquet(f"{tmp_path}/raw")
    assert rows == 100 and back.agg(F.min("row_number"), F.max("row_number"), F.count_distinct("row_number")).first()[:] == (1, 100, 100)
    assert spark.read.parquet(f"{tmp_path}/batches").first()["row_count"] == 100
    W.publish_release(spark, {"t": df}, f"{tmp_path}/rel", "r1")
    W.upsert_table(spark, spark.range(95, 105).select("id", F.lit(9).cast("long").alias("v")), ["id"], f"{tmp_path}/rel", "t", "r2")
    now = W.read_release(spark, f"{tmp_path}/rel", "t")
    W.publish_release(spark, {"t": now, "other": df}, f"{tmp_path}/rel2", "r1")
    W.upsert_table(spark, df, ["id"], f"{tmp_path}/rel2", "t", "r2")
    assert W.read_release(spark, f"{tmp_path}/rel2", "other").count() == 100
    with pytest.raises(ValueError):
        W.upsert_table(spark, df, ["id"], f"{tmp_path}/rel2", "t", "r2")
    assert W.current_release(spark, f"{tmp_path}/rel") == "r2" and now.count() == 105 and now.where("v = 9").count() == 10
    manifest = W.export_with_manifest(df, f"{tmp_path}/exp", "t", spark.range(98, 102), "id")
    assert manifest["exported_rows"] == 100 and manifest["sample_key_hits"] == 2
    assert manifest["content_sha256"] == W.content_hash(df.orderBy(F.desc("id"))) != W.content_hash(df.limit(99))
    swapped = [spark.createDataFrame([row], "a string, b string") for row in ((None, "x"), ("x", None))]
    assert W.content_hash(swapped[0]) != W.content_hash(swapped[1])
    W.write_report(spark, df.agg(F.count("*").alias("rows")), {"top": df.limit(3)}, f"{tmp_path}/rep", "Report")
    assert "rows: 100" in (tmp_path / "rep" / "report.md").read_text()


def test_stream(spark, tmp_path):
    """Two releases, batches of one file: each batch reads the current index and equals the batch operators."""
    from medlink.operators.match_index import Dictionary, store_index
    from medlink.streaming.lines import Evaluation, evaluate_matches, match_stream

    full, root = dictionary(spark).materialised(), f"{tmp_path}/index"
    poor = Dictionary(full.products.limit(0), full.concepts.where("canonical_name = 'OMEPRAZOLE'"), full.product_ingredients.limit(0), full.variants.limit(0))
    ids = sorted(r["ingredient_id"] for r in full.concepts.where("canonical_name in ('OMEPRAZOLE', 'ACARBOSE')").collect())
    pairs = spark.createDataFrame([(*ids, "major")], "ingredient_a string, ingredient_b string, severity string")
    known = Evaluation(full.product_ingredients, full.concepts, pairs)
    (tmp_path / "in").mkdir()
    stream = spark.readStream.schema("case_id long, input_index int, input_text string").parquet(f"{tmp_path}/in")
    for release, d in (("one", poor), ("two", full)):
        store_index(d, root, release)
        line_rows(spark).withColumn("case_id", F.col("case_id") + (10 if release == "two" else 0)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        query = match_stream(stream, root, f"{tmp_path}/out", f"{tmp_path}/chk", known, available_now=True)
        query.awaitTermination()
        assert query.exception() is None
    got = spark.read.parquet(f"{tmp_path}/out/matches")
    assert got.select("case_id", "input_index").distinct().count() == 2 * (len(GOLDEN) + 1)
    columns = ["case_id", "input_text", "match_method", "product_id", "ingredient_id"]

    def plain(df, names):
        return sorted(map(str, df.select(*names).collect()))

    first, second = got.where("case_id < 10"), got.where("case_id > 10")
    assert plain(first, columns) == plain(M.match_lines(line_rows(spark), poor), columns)
    later = line_rows(spark).withColumn("case_id", F.col("case_id") + 10)
    assert plain(second, columns) == plain(M.match_lines(later, full), columns)
    want = evaluate_matches(M.match_lines(later, full), known)
    for name, df in want.items():
        assert plain(spark.read.parquet(f"{tmp_path}/out/{name}").where("case_id > 10"), df.columns) == plain(df, df.columns), name
    assert plain(want["interactions"], ["case_id", "severity"]) == ["Row(case_id=11, severity='major')"]
    assert not list((tmp_path / "out" / "_texts").iterdir())


def names_of(spark, products):
    """A dictionary whose products have the given (English, Han) names; ingredients are the English names."""
    rows = [(f"P{i:05}", en, zh) for i, (en, zh) in enumerate(products)]
    p = spark.createDataFrame(rows, "product_code string, name_en string, name_zh string").withColumn("effective_start", F.lit("2020-01-01").cast("date"))
    mentions = p.where("name_en is not null").select("product_code", F.col("name_en").alias("mention"), F.lit("nhi").alias("source"))
    own = C.name_variants(p, mentions.limit(0)).select("target_type", "target_id", "variant_text", "normalized_text")
    return M.Dictionary(p, C.build_concepts(mentions), C.product_ingredients(mentions), own)


def test_word_pairs_against_every_name(spark):
    """Names of common words: covering and sharing by pairs of rarest words equal a comparison with every name."""
    import math
    import random

    rng = random.Random(5)
    common, rare = [f"COMMON{i}X" for i in range(5)], [f"RARE{i}X" for i in range(60)]

    def name():
        return " ".join(dict.fromkeys(rng.choices(common, k=rng.randint(0, 4)) + rng.choices(rare, k=rng.choice([0, 0, 1, 2])))) or "COMMON0X"

    products = [(name(), None) for _ in range(300)] + [("SOLO", None), ("COMMON0X COMMON1X", None)]
    d = names_of(spark, products).materialised()
    texts = [" ".join(rng.choices(common + rare, k=rng.randint(1, 9))) for _ in range(60)] + ["SOLO", "solo zz", "zz", " ".join(rare + common)]
    frame = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "input_text string")
    sets = [(f"P{i:05}", set(en.split())) for i, (en, _) in enumerate(products)]
    got = {r["input_text"]: r["product_id"] for r in M.product_contain_hits(frame, d).collect()}
    covered = {r["input_text"]: r["product_id"] for r in M.product_token_hits(frame, d).collect()}
    for text in dict.fromkeys(texts):
        words = text.upper().split()
        need = math.ceil(0.6 * len(words))
        ranked = sorted((-len(s & set(words)), p) for p, s in sets if len(s & set(words)) >= need)
        assert got.get(text) == (ranked[0][1] if ranked else None), text
        inside = {p for p, s in sets if s <= set(words)}
        assert covered.get(text) == (inside.pop() if len(inside) == 1 else None), text
    names = {r["input_text"]: r["canonical_name"] for r in M.ingredient_token_hits(frame, d).join(d.concepts, "ingredient_id").collect()}
    for text in dict.fromkeys(texts):
        inside = {frozenset(s) for _, s in sets if s <= set(text.upper().split())}
        assert (text in names) == (len(inside) == 1), text


def test_han_runs_against_every_name(spark, monkeypatch):
    import random

    rng = random.Random(6)
    signs = "藥糖錠膠囊膜衣止痛平"
    tail = "長效緩釋膜衣錠"  # a third of the names end alike
    products = [(None, "".join(rng.choices(signs, k=rng.randint(1, 9))) + (tail if i % 3 == 0 else "")) for i in range(150)]
    d = names_of(spark, products).materialised()
    whole = [n for _, n in rng.sample(products, 30)]
    texts = [n[: (k := rng.randrange(len(n) + 1))] + rng.choice(["", signs[0], "倍"]) + n[k:] for n in whole]
    texts += ["x " + t[:4] + " 5mg " + t[4:] for t in texts[:10]] + ["藥 ab", "糖糖糖", "abc", "藥" * 5000, "".join(rng.choices(signs, k=3000)), tail + "x"]
    frame = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "input_text string")

    def needles(text):
        runs = "".join(c if "一" <= c <= "鿿" else " " for c in text).split()
        for run in {r for r in runs if len(r) >= 3} | {" ".join(runs)}:
            if len(run) < 40:
                yield from {run} | {run[:i] + run[i + 1 :] for i in range(len(run))}

    for many in (256, 5):
        monkeypatch.setattr(M, "HALF_NAMES", many)
        got = {r["input_text"]: r["product_id"] for r in M.cjk_hits(frame, d).collect()}
        for text in dict.fromkeys(texts):
            found = set()
            if any("一" <= c <= "鿿" for c in text) and len(text) >= 3:
                found = {f"P{i:05}" for i, (_, n) in enumerate(products) for x in needles(text) if x in n}
            assert got.get(text) == (min(found) if 0 < len(found) <= 3 else None), (text[:40], many)


def test_search_limits_keep_the_best(spark):
    """Many names share every word; the short lists must still give the exact top of a full scoring."""
    from medlink.operators import search as R

    names = [f"{a} {b} {c}" for a in ("RED", "HOT", "OLD") for b in ("RING", "ROD") for c in range(40)]
    queries = ["red", "ring red", "ho", "rod hot 7", "old ring 39", "RED RING 5", "none"]
    got = R.ranked_search(
        spark.createDataFrame([(q,) for q in queries], "q string"), spark.createDataFrame(list(enumerate(names)), "id long, n string"), "q", "id", ["n"], 5
    ).collect()

    def score(q, n):
        words = list(dict.fromkeys(q.split(" ")))
        return 1.0 if q == n else 0.8 if n.startswith(q) else len(set(words) & set(n.split(" "))) / len(words) * 0.6

    for query in queries:
        q = query.upper()
        ranked = sorted((-score(q, n), n, i) for i, n in enumerate(names) if score(q, n) > 0)[:5]
        mine = sorted((r["rank"], r["item_id"]) for r in got if r["query"] == query)
        assert [i for _, i in mine] == [i for *_, i in ranked], query
