"""Work and broadcasts must grow with the tables, no faster."""

import re

from pyspark.sql import functions as F

from medlink.catalog import load
from medlink.catalog import matching_queries as Q
from medlink.catalog.registry import QUERIES
from medlink.operators import cases as G
from medlink.operators import matching as M
from medlink.operators import match_index as I
from medlink.operators.keyed import spread_join

SIGNS = "零一二三四五六七八九"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_alike_han_names_meet_a_run_in_few_rows(spark):
    """3,000 names of the same signs: each run brings at most limit + 1 products, and long names are still found by grams."""
    name = F.concat(F.lit("藥"), F.translate(F.col("id").cast("string"), "0123456789", SIGNS), F.lit("膠囊"))
    names = spark.range(1000, 4000).select(
        F.concat(F.lit("P"), "id").alias("product_id"), name.alias("product_name"), F.lit(True).alias("has_ids"), F.lit(None).cast("date").alias("effective_start")
    )
    texts = names.select(F.col("product_name").alias("input_text"))
    segments = M.han_segments(texts)
    found = M.near_names(segments, names, 3)
    most = found.groupBy("input_text").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert most <= 7 * 4  # seven needles, four products each; by grams a text met up to 1,000 names
    assert found.where("input_text = product_name").count() > 0
    long = "長" * 20 + "效緩釋膜衣錠" * 5
    rows = spark.createDataFrame([("Q1", long, True)], "product_id string, product_name string, has_ids boolean").withColumn("effective_start", F.lit(None).cast("date"))
    variants = rows.select(F.lit("product").alias("target_type"), F.col("product_id").alias("target_id"), F.col("product_name").alias("variant_text"), F.lit("").alias("normalized_text"))
    products = rows.select(F.col("product_id").alias("product_code"), F.lit(None).cast("string").alias("name_en"), F.col("product_name").alias("name_zh"), "effective_start")
    nothing = spark.createDataFrame([], "product_code string, ingredient_id string")
    concepts = spark.createDataFrame([], "ingredient_id string, canonical_name string, canonical_name_normalized string")
    d = I.Dictionary(products, concepts, nothing, variants)
    lines = spark.createDataFrame([(long[:40] + "倍" + long[40:],), (long[:33] + "倍",), (long[:32] + "倍",), (long + "倍",), ("倍" + long[:30] + "倍",)], "input_text string")
    got = {r["input_text"] for r in M.cjk_hits(lines, d).collect()}
    assert got == {r["input_text"] for r in lines.collect()} - {"倍" + long[:30] + "倍"}


def test_matching_broadcasts_no_growing_table(spark, tmp_path):
    """Files of few words are small and hold many rows, so Spark takes them for small tables."""
    for table in ("part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
    texts = M.distinct_texts(Q.match_input(spark, str(tmp_path)))
    d = Q.dictionary(spark, str(tmp_path))
    for hits in (M.exact_hits, M.ingredient_token_hits, M.product_contain_hits, M.product_token_hits, M.single_clean_hits, M.strict_clean_hits):
        assert "Broadcast" not in plan_of(hits(texts, d)).replace("spark.sql.autoBroadcast", ""), hits.__name__
    assert plan_of(M.cjk_hits(texts, d)).count("BroadcastHashJoin") == 1  # lengths of runs, at most 33 rows


def test_a_text_is_worked_out_once_not_once_a_line(spark):
    """Spark moves filters on the keys and stems of a text below the distinct, where they are worked out for every line."""
    sf = "/root/testdata/sf0.001"
    texts, d = M.distinct_texts(Q.match_input(spark, sf)), Q.dictionary(spark, sf)
    for hits in (M.exact_hits, M.ingredient_token_hits, M.product_contain_hits, M.product_token_hits, M.single_clean_hits, M.strict_clean_hits):
        plan = plan_of(hits(texts, d))
        joins = [line for line in plan.splitlines() if "SortMergeJoin [l_partkey" in line]
        assert joins and not [j for j in joins if "regexp_replace" in j], hits.__name__


def test_lines_of_a_part_meet_it_as_one_row(spark, tmp_path):
    """Every line was joined with its part's texts, all five keys were made of each text, and a spelling was normalised once a product."""
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, n, p) for k in [*range(12), -5, None] for n in (1, 2, None) for p in (3, 4, None)] * 2
    spark.createDataFrame(lines, "l_orderkey int, l_linenumber int, l_partkey int").write.parquet(f"{tmp_path}/lineitem.parquet")
    for sf in (str(tmp_path), "/root/testdata/sf0.001"):
        want = M.distinct_texts(Q.match_input(spark, sf)).collect()
        assert sorted(Q.match_texts(spark, sf).collect()) == sorted(want)
    plan = plan_of(QUERIES["match_product_exact"](spark, sf))
    below = plan[plan.index("SortMergeJoin [l_partkey") :]
    assert "bit_or" in below and "SortMergeJoin" not in below[20:]
    assert "總量" not in plan  # of the dosage tail, which another key drops
    concepts = plan_of(Q.dictionary(spark, sf).concepts.where("length(canonical_name_normalized) >= 3"))
    assert "regexp_replace" not in concepts[concepts.rindex("HashAggregate(keys=[mention") :]


def test_strict_clean_up_broadcasts_no_texts(spark, tmp_path):
    """Adaptive execution took the words of all texts for the small side while they fitted; the rows of a hot word met in one task."""
    sf = "/root/testdata/sf0.001"
    texts, d = M.distinct_texts(Q.match_input(spark, sf)), Q.dictionary(spark, sf)
    hits = M.strict_clean_hits(texts, d)
    hits.collect()
    assert "Broadcast" not in plan_of(hits)
    hot = spark.range(400).select(F.concat(F.lit("t"), "id").alias("input_text"), F.lit("hot").alias("word"))
    stems = spark.createDataFrame([("hot", "HOT"), ("cold", "COLD")], "word string, pharma_stem string")
    joined = spread_join(hot, stems, "word", "input_text")
    assert sorted(tuple(r) for r in joined.collect()) == sorted(("hot", f"t{i}", "HOT") for i in range(400))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        largest = spread_join(hot, stems, "word", "input_text").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert largest < 300


def test_part_work_is_spread_over_the_cores(spark, tmp_path):
    """One small file of parts holds many rows; texts and dictionary were built in one task, texts once a line."""
    spark.read.parquet("/root/testdata/sf0.001/part.parquet").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    lines = [(k, n, p) for k in [*range(12), -5, None] for n in (1, 2, None) for p in (3, 4)]
    spark.createDataFrame(lines, "l_orderkey int, l_linenumber int, l_partkey int").write.parquet(f"{tmp_path}/lineitem.parquet")
    cores = spark.sparkContext.defaultParallelism
    assert Q.dictionary(spark, str(tmp_path)).products.rdd.getNumPartitions() == cores
    found = Q.match_input(spark, str(tmp_path))
    assert f"RoundRobinPartitioning({cores})" in plan_of(found)
    names = {r["p_partkey"]: (r["p_name"], r["p_type"], r["p_brand"]) for r in spark.read.parquet(f"{tmp_path}/part.parquet").collect()}

    def text(k, n, p):
        (name, kind, brand), odd = names[p], n is None or n % 2
        form, noun, key = kind.lower(), name.split(" ")[1], "藥" + "".join(SIGNS[int(c)] for c in str(p))
        if k is None or k < 0 or k == 11:
            return f"use ({name} & {brand})"
        return [
            f"{name} {form}", name.upper(), f"{name} salt", f"60puff/bot({name})", f"{name} {form} 5mg tab", f"{name} extra strength", f"{form} {noun}s zzz",
            f"十全{noun.upper() if odd else kind}S12 XYZ", key + ("膠 每日" if odd else "膠囊"), form, f"unknown thing {p % 7}",
        ][k]

    key = lambda t: tuple(str(c) for c in t)
    assert sorted(map(tuple, found.collect()), key=key) == sorted(((k, n, text(k, n, p)) for k, n, p in lines), key=key)


def test_a_query_stores_only_the_tables_it_asks(spark):
    sf = "/root/testdata/sf0.001"
    Q._STORED.pop((spark.sparkContext.applicationId, sf), None)
    index = Q.matching_index(spark, sf, "exact_keys")
    assert index.exact_keys is not None and index.han_names is None
    index = Q.matching_index(spark, sf, "tokens")
    assert index.exact_keys is not None and index.tokens is not None


def test_lists_are_mapped_to_bases_before_they_multiply(spark, monkeypatch):
    from medlink.operators import lists as P

    concepts = spark.createDataFrame([("base", "ring")] + [(f"d{i}", f"ring {i} MG") for i in range(50)], "ingredient_id string, canonical_name string")
    items = spark.range(200).select(F.col("id").alias("list_id"), F.when(F.col("id") % 2 == 0, "P1").alias("product_code"), F.lit("RING").alias("name_en"))
    owned = spark.createDataFrame([("P1", "d7")], "product_code string, ingredient_id string")
    real, rows = P.base_ingredients, []
    monkeypatch.setattr(P, "base_ingredients", lambda ids, c: rows.append(ids.count()) or real(ids, c))
    got = P.list_ingredients(items, owned, concepts).collect()
    assert sorted(tuple(r) for r in got) == [(i, "base") for i in range(200)]
    assert sum(rows) == 1 + 51  # one product, one name of 51 concepts; it was 100 + 100 * 51


def test_names_of_pairs_and_rows_of_cases_stay_small_in_a_task(spark, tmp_path, monkeypatch):
    """The names of pairs were broadcast as their file is small; a task of cases grew with the input."""
    from medlink.operators import interactions as D

    spark.range(100).select(F.concat(F.lit("N"), "id").alias("drug_name"), F.concat(F.lit("I"), F.col("id") % 9).alias("ingredient_id")).write.parquet(f"{tmp_path}/names")
    raw = spark.range(50).select(
        F.concat(F.lit("N"), "id").alias("drug_a"), F.concat(F.lit("N"), F.col("id") + 1).alias("drug_b"),
        F.lit("minor").alias("severity"), F.lit("a").alias("sources"), F.lit("1").alias("raw_rows"),
    )
    pairs = D.import_pairs(raw, spark.read.parquet(f"{tmp_path}/names"))
    assert "Broadcast" not in plan_of(pairs)
    written = []
    monkeypatch.setattr(D, "TASK_ROWS", 10)
    real = D.checkpointed
    monkeypatch.setattr(D, "checkpointed", lambda df: written.append(df) or real(df))
    codes = spark.createDataFrame(
        [(c, p, n) for c in range(40) for n, p in enumerate(["P1", " P2", "P9", "P1", ""])] + [(1, "P0", None)], "case_id long, product_code string, position int"
    )
    ids = spark.createDataFrame([(c, i) for c in range(40) for i in (" I5", "I5", "I7", "")] , "case_id long, ingredient_id string")
    texts = spark.createDataFrame([(3, " x "), (3, "x")], "case_id long, raw_text string")
    owned = spark.createDataFrame([("P1", "I1"), ("P2", "I1"), ("P2", "I2"), ("P2", "I2"), ("P0", "I1"), ("P0", "I8")], "product_code string, ingredient_id string")
    concepts = spark.createDataFrame([(f"I{i}", f"name {i}") for i in (1, 2, 5)], "ingredient_id string, canonical_name string")
    found = D.evaluate_cases(codes, ids, texts, owned, concepts, pairs)
    assert written[0].rdd.getNumPartitions() == (201 + 160) // 10 + 1
    assert sorted(map(tuple, found["checked"].collect())) == sorted((c, i, f"name {i[1]}") for c in range(40) for i in ("I1", "I2", "I5"))
    lacking = [(c, "missing_ingredient_concept", "I7", None) for c in range(40)] + [(1, "missing_ingredient_concept", "I8", "P0")]
    unknown = [(c, "unknown_product", None, "P9") for c in range(40)] + [(3, "unknown_product", "x", None)]
    assert sorted(map(str, map(tuple, found["unchecked"].collect()))) == sorted(map(str, lacking + unknown))
    assert sorted(tuple(r)[:3] for r in found["interactions"].collect()) == sorted((c, "I1", "I2") for c in range(40))


def test_lines_of_cases_move_once_and_as_they_are(spark):
    """Lines were shuffled as distinct rows, then once an ingredient with every name twice, then again for their case."""
    sf = "/root/testdata/sf0.001"
    plan = plan_of(load()[0]["case_items"](spark, sf))
    assert plan.count("Exchange hashpartitioning(case_id") == 1
    assert plan.index("Exchange hashpartitioning(case_id") < plan.index("SortMergeJoin [input_text")  # of lines that are not multiplied yet


def test_cards_are_the_same_however_lines_are_spread(spark):
    sf = "/root/testdata/sf0.001"
    index = Q.matching_index(spark, sf)
    lines = Q.match_input(spark, sf).selectExpr("l_orderkey as case_id", "l_linenumber as input_index", "input_text")
    lines = lines.where("case_id % 7 < 2").unionByName(lines.where("case_id % 21 = 0")).selectExpr("case_id", "input_index", "nullif(input_text, 'unknown thing 3') as input_text")
    flat = M.match_lines(lines, index)
    nested = M.match_lines(lines, index, texts=M.distinct_texts(lines), nested=True)
    assert nested.count() == lines.count()
    rows = M.match_rows(nested).select(flat.columns)
    assert rows.exceptAll(flat).isEmpty() and flat.exceptAll(rows).isEmpty()
    want = sorted(map(str, G.detected_items(flat).collect()))
    assert want == sorted(map(str, G.detected_items(M.match_lines(lines.distinct(), index)).collect()))
    for matches, tasks in ((nested, 3), (nested, None), (flat, 3)):
        assert sorted(map(str, G.detected_items(matches, tasks=tasks).collect())) == want


def test_smallest_product_of_a_stem_needs_no_ranking(spark):
    """Stems were ranked once for the pairs and again for this table; products of a text were counted in two shuffles."""
    d = Q.dictionary(spark, "/root/testdata/sf0.001")
    pairs, single, _ = I.overlap_index(d)
    assert "collect_list" not in plan_of(single) and "collect_list" in plan_of(pairs)
    hits = plan_of(M.cjk_hits(Q.match_texts(spark, "/root/testdata/sf0.001"), d))
    assert "collect_set(product_id" in hits and not re.search(r"hashpartitioning\(input_text#\d+, product_id", hits)
