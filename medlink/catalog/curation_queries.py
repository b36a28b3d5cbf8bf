"""De-duplication, linking, curation, review and quality over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from medlink.catalog.registry import query, spread, sql_name_key, sql_norm, sql_stem, sql_uuid, table
from medlink.catalog.text_queries import sql_compare_key, sql_strip_strength
from medlink.functions import text as T
from medlink.operators import curate as C
from medlink.operators import interactions as D
from medlink.operators import keyed as K
from medlink.operators import quality as Q
from medlink.operators import search as R


@query(
    "latest_version",
    """
    WITH v AS (SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS s,
        CASE WHEN o_orderstatus <> 'O' THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 50 AS INTEGER) END AS e FROM orders)
    SELECT o_custkey, o_orderkey, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date FROM (SELECT *, row_number() OVER (
        PARTITION BY o_custkey ORDER BY s DESC NULLS LAST, e DESC NULLS FIRST, o_orderkey DESC) AS rn FROM v) WHERE rn = 1
    """,
)
def _latest_version(spark: SparkSession, sf: str) -> DataFrame:
    day = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderstatus") != "O", F.date_add(day, (F.col("o_orderkey") % 50).cast("int")))
    versions = table(spark, sf, "orders").select("o_custkey", "o_orderkey", day.alias("s"), end.alias("e"))
    newest = K.latest_version(versions, "o_custkey", "s", "e", ["o_orderkey"])
    return newest.select(
        "o_custkey", "o_orderkey", F.col("s").cast("string").alias("start_date"), F.col("e").cast("string").alias("end_date")
    )


@query(
    "keep_first",
    """
    SELECT l_partkey, l_returnflag, l_linestatus, l_orderkey, l_linenumber FROM (SELECT *, row_number() OVER (
        PARTITION BY l_partkey, l_returnflag, l_linestatus ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1
    """,
)
def _keep_first(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", "l_returnflag", "l_linestatus", "l_orderkey", "l_linenumber")
    return K.keep_first(rows, ["l_partkey", "l_returnflag", "l_linestatus"], ["l_orderkey", "l_linenumber"])


@query(
    "overlay_lookup",
    """
    SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey * 3 FROM supplier)
    UNION ALL SELECT s_suppkey * 3, s_name, s_nationkey FROM supplier
    """,
)
def _overlay_lookup(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")
    )
    top = table(spark, sf, "supplier").select(
        (F.col("s_suppkey") * 3).alias("key"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("nation")
    )
    return K.overlay(base, top, "key")


LINK_SQL = f"""
    WITH prod AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Supplier#' || lpad(CAST(c_custkey % 120 AS VARCHAR), 9, '0')
            WHEN 3 THEN 'Z12' ELSE '01' || lpad(CAST(c_custkey % 120 AS VARCHAR), 6, '0') END AS token,
        {sql_norm('c_mktsegment')} AS nm, 'FORM ' || (c_nationkey % 3) AS form FROM customer),
    permit AS (SELECT s_name AS permit_no, 'FORM ' || (s_nationkey % 3) AS form, 'ZH' AS zh,
            CASE s_suppkey % 3 WHEN 0 THEN 'BUILDING' WHEN 1 THEN 'MACHINERY' ELSE 'x' END AS en, s_suppkey AS k FROM supplier
        UNION ALL SELECT 'Permit ' || lpad(CAST(s_suppkey AS VARCHAR), 7, '0'), 'FORM 1', 'ZH2',
            CASE s_suppkey % 2 WHEN 0 THEN 'building' ELSE 'Household' END, s_suppkey FROM supplier WHERE s_acctbal > 0),
    tail AS (SELECT *, right(regexp_replace(permit_no, '[^0-9]', '', 'g'), 6) AS t FROM permit),
    direct AS (SELECT c_custkey, token AS permit_no FROM prod WHERE token IN (SELECT permit_no FROM permit)),
    rest AS (SELECT *, right(regexp_replace(token, '[^0-9]', '', 'g'), 6) AS t FROM prod
        WHERE c_custkey NOT IN (SELECT c_custkey FROM direct) AND length(regexp_replace(token, '[^0-9]', '', 'g')) >= 6),
    cand AS (SELECT c_custkey, permit_no, {sql_norm('en')} = nm OR {sql_norm('zh')} = nm AS by_name, tail.form = rest.form AS by_form FROM rest JOIN tail USING (t)),
    agg AS (SELECT c_custkey, count(*) AS n, count(*) FILTER (by_name) AS named, min(permit_no) FILTER (by_name) AS p_name,
        min(permit_no) FILTER (by_form) AS p_form, min(permit_no) AS p_any FROM cand GROUP BY c_custkey)
    SELECT 'C' || c_custkey AS product_code, permit_no FROM direct UNION ALL
    SELECT 'C' || c_custkey, CASE WHEN n = 1 THEN p_any WHEN named = 1 THEN p_name ELSE coalesce(p_form, p_any) END FROM agg
"""


@query("suffix_link", LINK_SQL)
def _suffix_link(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    digits = (key % 120).cast("string")
    link = (
        F.when(key % 4 == 0, F.concat(F.lit("http://x/q?permitNo=Supplier%23"), F.lpad(digits, 9, "0")))
        .when(key % 4 == 3, F.lit("http://x/Z12"))
        .otherwise(F.concat(F.lit("http://x/q?licId=01"), F.lpad(digits, 6, "0")))
    )
    products = table(spark, sf, "customer").select(
        F.concat(F.lit("C"), key.cast("string")).alias("product_code"),
        link.alias("permit_link"),
        F.col("c_mktsegment").alias("name_en"),
        F.lit(None).cast("string").alias("name_zh"),
        F.concat(F.lit("Form-"), (F.col("c_nationkey") % 3).cast("string")).alias("dose_form"),
    )
    supplier, skey = table(spark, sf, "supplier"), F.col("s_suppkey")
    first = supplier.select(
        F.col("s_name").alias("permit_no"),
        F.lit("ZH").alias("product_name_zh"),
        F.when(skey % 3 == 0, "BUILDING").when(skey % 3 == 1, "MACHINERY").otherwise("x").alias("product_name_en"),
        F.concat(F.lit("form "), (F.col("s_nationkey") % 3).cast("string")).alias("dosage_form"),
    )
    second = supplier.where(F.col("s_acctbal") > 0).select(
        F.concat(F.lit("Permit "), F.lpad(skey.cast("string"), 7, "0")).alias("permit_no"),
        F.lit("ZH2").alias("product_name_zh"),
        F.when(skey % 2 == 0, "building").otherwise("Household").alias("product_name_en"),
        F.lit("form 1").alias("dosage_form"),
    )
    return C.link_permits(products, first.unionByName(second))


@query(
    "token_index",
    f"""
    WITH t AS (SELECT DISTINCT doc_id, unnest(string_split({sql_norm('text')}, ' ')) AS token FROM documents)
    SELECT doc_id, token, {sql_stem('token')} AS token_stem FROM t WHERE length(token) >= 2
    """,
)
def _token_index(spark: SparkSession, sf: str) -> DataFrame:
    names = table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("n"))
    return C.token_index(names, ["doc_id"], "n")


@query(
    "token_counts",
    f"""
    WITH t AS (SELECT doc_id, unnest(string_split({sql_norm('text')}, ' ')) AS token FROM documents)
    SELECT CAST(doc_id AS VARCHAR) AS product_code, count(DISTINCT {sql_stem('token')}) AS token_count FROM t WHERE length(token) >= 2 GROUP BY 1
    """,
)
def _token_counts(spark: SparkSession, sf: str) -> DataFrame:
    variants = table(spark, sf, "documents").select(
        F.lit("product").alias("target_type"),
        F.col("doc_id").cast("string").alias("target_id"),
        F.lit("en").alias("variant_id"),
        T.normalize_text("text").alias("normalized_text"),
    )
    return C.token_counts(C.variant_token_index(variants))


@query(
    "jaccard_overlap",
    f"""
    WITH w AS (SELECT DISTINCT conv_id, role, unnest(string_split({sql_norm('text')}, ' ')) AS word FROM conversations WHERE role IN ('user', 'assistant')),
    m AS (SELECT conv_id, word, max(CASE role WHEN 'user' THEN 1 ELSE 0 END) AS l, max(CASE role WHEN 'assistant' THEN 1 ELSE 0 END) AS r
        FROM w WHERE length(word) >= 2 GROUP BY conv_id, word)
    SELECT conv_id, CAST(sum(l * r) AS BIGINT) AS "both", count(*) AS either, CAST(sum(l * (1 - r)) AS BIGINT) AS left_only,
        CAST(sum(r * (1 - l)) AS BIGINT) AS right_only, CAST(sum(l * r) AS DOUBLE) / count(*) AS ratio FROM m GROUP BY conv_id
    """,
)
def _jaccard_overlap(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    side = lambda role: turns.where(F.col("role") == role).select(
        "conv_id", F.explode(F.array_distinct(T.words(T.normalize_text("text")))).alias("word")
    )
    return C.set_overlap(side("user"), side("assistant"), "conv_id", "word")


ITEM_TEXT_SQL = "CASE p_partkey % 4 WHEN 0 THEN p_name || ' 5 mg + ' || p_type WHEN 1 THEN p_name WHEN 2 THEN p_name || ', ' || p_type || ', ' || p_brand ELSE '  ' END"
PERMIT_TEXT_SQL = "CASE p_partkey % 4 WHEN 0 THEN lower(p_type) || ' ;; ' || p_name WHEN 1 THEN p_brand || ';;' WHEN 2 THEN p_name || ' 10 MG ;; other ;; third' ELSE p_name END"


def review_pairs(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    item = (
        F.when(key % 4 == 0, F.concat("p_name", F.lit(" 5 mg + "), "p_type")).when(key % 4 == 1, F.col("p_name"))
        .when(key % 4 == 2, F.concat("p_name", F.lit(", "), "p_type", F.lit(", "), "p_brand")).otherwise(F.lit("  "))
    )
    permit = (
        F.when(key % 4 == 0, F.concat(F.lower("p_type"), F.lit(" ;; "), "p_name")).when(key % 4 == 1, F.concat("p_brand", F.lit(";;")))
        .when(key % 4 == 2, F.concat("p_name", F.lit(" 10 MG ;; other ;; third"))).otherwise(F.col("p_name"))
    )
    return spread(table(spark, sf, "part")).select(
        F.concat(F.lit("P"), key.cast("string")).alias("product_code"),
        F.concat(F.lit("L"), (key % 9).cast("string")).alias("permit_no"),
        item.alias("item_text"),
        permit.alias("permit_text"),
    )


@query(
    "jaccard_review",
    f"""
    WITH raw AS (SELECT 'P' || p_partkey AS product_code, 'L' || (p_partkey % 9) AS permit_no, {ITEM_TEXT_SQL} AS item_text, {PERMIT_TEXT_SQL} AS permit_text FROM part),
    ip AS (SELECT product_code, unnest(list_filter(list_transform(regexp_split_to_array({sql_strip_strength('item_text')}, '(?i)\\s*(?:;;|,|\\+|/| AND )\\s*'),
        lambda x: trim(x)), lambda x: x <> '')) AS x FROM raw),
    pp AS (SELECT product_code, unnest(list_filter(list_transform(string_split(permit_text, ';;'), lambda x: trim(x)), lambda x: x <> '')) AS x FROM raw),
    a AS (SELECT DISTINCT product_code, {sql_compare_key(sql_strip_strength('x'))} AS k FROM ip),
    b AS (SELECT DISTINCT product_code, {sql_compare_key(sql_strip_strength('x'))} AS k FROM pp),
    m AS (SELECT product_code, k, max(l) AS l, max(r) AS r FROM (SELECT product_code, k, 1 AS l, 0 AS r FROM a WHERE k <> '' UNION ALL
        SELECT product_code, k, 0, 1 FROM b WHERE k <> '') GROUP BY product_code, k),
    s AS (SELECT product_code, sum(l) AS nl, sum(r) AS nr, sum(l * r) AS shared, count(*) AS n, sum(r * (1 - l)) AS extra FROM m GROUP BY product_code),
    c AS (SELECT product_code, string_agg(DISTINCT {sql_uuid(sql_norm('x'))}, ',' ORDER BY {sql_uuid(sql_norm('x'))}) AS candidates
        FROM (SELECT * FROM ip UNION ALL SELECT * FROM pp) GROUP BY product_code),
    pt AS (SELECT product_code, array_to_string(list_filter(list_transform(string_split(permit_text, ';;'), lambda x: trim(x)), lambda x: x <> ''), ' ;; ') AS ocr_text FROM raw)
    SELECT product_code, permit_no, item_text AS input_text, ocr_text, candidates, CAST(shared AS DOUBLE) / n AS confidence,
        'NHI ingredients: ' || item_text || '; TFDA ingredients: ' || ocr_text AS review_notes
    FROM raw JOIN s USING (product_code) JOIN c USING (product_code) JOIN pt USING (product_code)
    WHERE nl > 0 AND nr > 0 AND extra > 0 AND CAST(shared AS DOUBLE) / n < 0.6
    """,
)
def _jaccard_review(spark: SparkSession, sf: str) -> DataFrame:
    return C.mismatch_items(review_pairs(spark, sf)).select(
        "product_code", "permit_no", "input_text", "ocr_text",
        F.array_join("candidate_ingredient_ids", ",").alias("candidates"), "confidence", "review_notes",
    )


@query(
    "review_merge",
    """
    WITH old AS (SELECT 'old' || p_partkey AS review_id, CASE p_partkey % 3 WHEN 0 THEN 'tfda_mismatch' ELSE 'unknown_brand' END AS source,
        CASE p_partkey % 2 WHEN 0 THEN 'pending' ELSE 'approved' END AS status, 'P' || p_partkey AS product_code,
        CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS permit_no, p_name AS input_text, p_type AS ocr_text FROM part),
    fresh AS (SELECT 'new' || p_partkey AS review_id, 'tfda_mismatch' AS source, 'pending' AS status, 'P' || p_partkey AS product_code,
        CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS permit_no, p_name AS input_text, p_type AS ocr_text FROM part),
    kept AS (SELECT * FROM old WHERE NOT (source = 'tfda_mismatch' AND status = 'pending'))
    SELECT * FROM kept UNION ALL SELECT * FROM fresh f WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.source = f.source AND k.product_code = f.product_code
        AND k.permit_no IS NOT DISTINCT FROM f.permit_no AND k.input_text = f.input_text AND k.ocr_text = f.ocr_text)
    """,
)
def _review_merge(spark: SparkSession, sf: str) -> DataFrame:
    part, key = table(spark, sf, "part"), F.col("p_partkey")

    def queue(prefix: str, source, status) -> DataFrame:
        return part.select(
            F.concat(F.lit(prefix), key.cast("string")).alias("review_id"),
            source.alias("source"),
            status.alias("status"),
            F.concat(F.lit("P"), key.cast("string")).alias("product_code"),
            F.when(key % 5 > 0, F.col("p_brand")).alias("permit_no"),
            F.col("p_name").alias("input_text"),
            F.col("p_type").alias("ocr_text"),
        )

    old = queue("old", F.when(key % 3 == 0, "tfda_mismatch").otherwise("unknown_brand"), F.when(key % 2 == 0, "pending").otherwise("approved"))
    return C.carry_over_reviews(old, queue("new", F.lit("tfda_mismatch"), F.lit("pending")))


@query(
    "enriched_view",
    """
    WITH o AS (SELECT o_custkey, o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS p FROM orders),
    l AS (SELECT o_custkey, CAST(floor((p - 1) / 8) AS INTEGER) AS chunk_no, string_agg(o_orderkey || ':' || o_orderpriority, '|' ORDER BY p) AS order_list FROM o GROUP BY 1, 2),
    n AS (SELECT o_custkey, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY o_custkey)
    SELECT c_custkey, n_name, chunk_no, order_list, priorities FROM customer JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN n ON n.o_custkey = c_custkey
    """,
)
def _enriched_view(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    item = F.concat(F.col("o_orderkey").cast("string"), F.lit(":"), "o_orderpriority")
    band = K.hot_band(orders, ["o_custkey"], F.year("o_orderdate"))
    lists = R.nested_lists(
        orders, ["o_custkey"], [F.col("o_orderdate"), F.col("o_orderkey")], item, "items", band, chunk=8
    )
    # Distinct names per parent: one of five priorities, so the set is small by nature.
    names = orders.groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("priorities"))
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey").join(nation, "c_nationkey")
    return customer.join(lists, "o_custkey", "left").join(names, "o_custkey", "left").select(
        F.col("o_custkey").alias("c_custkey"), "n_name", "chunk_no", F.array_join("items", "|").alias("order_list"), "priorities"
    )


@query(
    "coverage_qc",
    """
    WITH c AS (SELECT CAST(c_custkey AS VARCHAR) AS code, nullif(c_mktsegment, 'MACHINERY') AS atc FROM customer),
    k AS (SELECT DISTINCT CAST(c_custkey * 2 AS VARCHAR) AS code FROM customer),
    f AS (SELECT count(*) AS products, count(*) FILTER (code IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')) AS with_ingredients,
        count(*) FILTER (code IN (SELECT CAST(o_custkey AS VARCHAR) FROM orders WHERE o_orderpriority = '5-LOW')) AS with_permit,
        count(*) FILTER (atc IS NOT NULL) AS with_atc, count(*) FILTER (atc IS NOT NULL AND atc <> 'BUILDING') AS with_known_atc,
        count(*) FILTER (code IN (SELECT code FROM k)) AS overlap FROM c)
    SELECT products, with_ingredients, with_permit, with_atc, with_known_atc, (SELECT count(*) FROM k) AS code_set_size, overlap,
        (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS review_items, CAST(0 AS BIGINT) AS alias_uses,
        printf('%.2f%%', with_ingredients * 100.0 / products) AS with_ingredients_pct, printf('%.2f%%', with_permit * 100.0 / products) AS with_permit_pct,
        printf('%.2f%%', with_atc * 100.0 / products) AS with_atc_pct, printf('%.2f%%', with_known_atc * 100.0 / products) AS with_known_atc_pct,
        printf('%.2f%%', overlap * 100.0 / products) AS overlap_pct, (SELECT count(*) FROM k) - overlap AS code_set_only FROM f
    """,
)
def _coverage_qc(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    code = lambda c: F.col(c).cast("string").alias("product_code")
    products = customer.select(code("c_custkey"), F.nullif("c_mktsegment", F.lit("MACHINERY")).alias("atc_code"))
    return Q.coverage_summary(
        products,
        orders.where(F.col("o_orderstatus") == "F").select(code("o_custkey")),
        orders.where(F.col("o_orderpriority") == "5-LOW").select(code("o_custkey")),
        customer.where(F.col("c_mktsegment") != "BUILDING").select(F.col("c_mktsegment").alias("atc_code")),
        customer.select((F.col("c_custkey") * 2).cast("string").alias("product_code")),
        orders.where(F.col("o_orderpriority") == "1-URGENT"),
    )


@query(
    "code_set_ops",
    """
    SELECT code, CASE WHEN max(l) + max(r) = 2 THEN 'both' WHEN max(l) = 1 THEN 'left_only' ELSE 'right_only' END AS side FROM
        (SELECT c_custkey AS code, 1 AS l, 0 AS r FROM customer UNION ALL SELECT o_custkey * 2, 0, 1 FROM orders) GROUP BY code
    """,
)
def _code_set_ops(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "customer").select(F.col("c_custkey").alias("code"))
    right = table(spark, sf, "orders").select((F.col("o_custkey") * 2).alias("code"))
    return Q.code_set_relations(left, right, "code")


@query(
    "constraint_checks",
    """
    SELECT 'unique order line' AS rule, count(*) AS violations FROM (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)
    UNION ALL SELECT 'part name present', count(*) FROM part WHERE p_name IS NULL
    UNION ALL SELECT 'discount at most 5 %', count(*) FROM lineitem WHERE NOT l_discount <= 0.05
    UNION ALL SELECT 'order customer exists', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)
    """,
)
def _constraint_checks(spark: SparkSession, sf: str) -> DataFrame:
    lineitem, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    good = table(spark, sf, "customer").where(F.col("c_acctbal") > 0)
    return Q.run_rules(
        [
            Q.unique_rule("unique order line", lineitem, ["l_orderkey", "l_linenumber"]),
            Q.not_null_rule("part name present", part, "p_name"),
            Q.check_rule("discount at most 5 %", lineitem, F.col("l_discount") <= 0.05),
            Q.reference_rule("order customer exists", table(spark, sf, "orders"), "o_custkey", good, "c_custkey"),
        ]
    )


@query("status_counts", "SELECT o_orderstatus AS source, o_orderpriority AS status, count(*) AS n FROM orders GROUP BY 1, 2")
def _status_counts(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy(
        F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("status")
    ).agg(F.count(F.lit(1)).alias("n"))


COUNTED = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@query("table_counts", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in COUNTED))
def _table_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.table_counts({t: table(spark, sf, t) for t in COUNTED})


@query(
    "top_mismatches",
    """SELECT CAST(o_orderkey AS VARCHAR) AS review_id, o_orderpriority AS notes FROM orders WHERE o_orderstatus = 'F'
    ORDER BY o_orderdate DESC, CAST(o_orderkey AS VARCHAR) LIMIT 200""",
)
def _top_mismatches(spark: SparkSession, sf: str) -> DataFrame:
    reviews = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "F", "tfda_mismatch").otherwise("other").alias("source"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderkey").cast("string").alias("review_id"),
        F.col("o_orderpriority").alias("notes"),
    )
    return Q.newest_mismatches(reviews, 200).select("review_id", "notes")


# --- curated tables ---------------------------------------------------------------


def raw_items(spark: SparkSession, sf: str) -> DataFrame:
    """Three versions of every part as an item table."""
    key, part = F.col("p_partkey"), table(spark, sf, "part")
    return part.select(
        F.concat(F.lit("P"), key.cast("string")).alias("product_code"),
        "p_name", "p_type", "p_brand", "p_size", "p_retailprice", key.alias("k"),
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("v"),
    ).select(
        "product_code",
        F.concat("p_name", F.lit(" v"), F.col("v").cast("string")).alias("name_en"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("藥"), F.col("p_type"))).alias("name_zh"),
        F.concat("p_name", F.lit(" + "), "p_brand").alias("ingredient_text"),
        F.col("p_type").alias("dose_form"),
        F.when(F.col("k") % 3 == 0, "複方").otherwise("單方").alias("combo_flag"),
        F.concat(F.lit("http://x/q?licId=01"), F.lpad((F.col("k") % 150).cast("string"), 6, "0")).alias("permit_link"),
        F.date_add(F.to_date(F.lit("2020-01-01")), F.when(F.col("k") % 4 == 0, 5).otherwise(F.col("v"))).alias("effective_start"),
        F.when(F.col("v") < 2, F.date_add(F.to_date(F.lit("2021-01-01")), F.col("v"))).alias("effective_end"),
    )


ITEMS_SQL = """items AS (SELECT 'P' || p_partkey AS product_code, p_name || ' v' || v AS name_en, CASE WHEN p_partkey % 2 = 0 THEN '藥' || p_type END AS name_zh,
        p_name || ' + ' || p_brand AS ingredient_text, p_type AS dose_form, p_partkey % 3 = 0 AS is_combo, p_partkey AS k,
        lpad(CAST(p_partkey % 150 AS VARCHAR), 6, '0') AS tail, DATE '2020-01-01' + CASE WHEN p_partkey % 4 = 0 THEN 5 ELSE v END AS s,
        CASE WHEN v < 2 THEN DATE '2021-01-01' + v END AS e FROM part, (VALUES (0), (1), (2)) AS x(v)),
    products AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_code ORDER BY s DESC, e DESC NULLS FIRST, name_en DESC) AS rn FROM items) WHERE rn = 1)"""


def raw_permits(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    key = F.col("s_suppkey")
    base = table(spark, sf, "supplier").select(
        F.concat(F.lit("部第"), F.lpad(key.cast("string"), 6, "0"), F.lit("號")).alias("permit_no"),
        F.when(key % 3 == 0, "未註銷").otherwise("已註銷").alias("cancel_status"),
        F.lit(None).cast("date").alias("cancel_date"),
        F.lit(None).cast("date").alias("expiry_date"),
        F.lit(None).cast("date").alias("issue_date"),
        F.lit(None).cast("string").alias("controlled_substance_level"),
        F.when(key % 2 == 0, F.lit("")).otherwise(F.lit("中文")).alias("product_name_zh"),
        F.col("s_name").alias("product_name_en"),
        F.lit("錠").alias("dosage_form"),
        F.lit("盒").alias("packaging"),
        F.concat(F.lit("red plate ;; Substance "), key.cast("string")).alias("ingredient_text"),
        F.col("s_name").alias("applicant_name"),
        F.lit("a").alias("applicant_address"),
        F.lit("1").alias("applicant_tax_id"),
        F.lit("m").alias("manufacturer_name"),
        F.lit("site").alias("manufacturer_site_address"),
        F.when(key % 5 == 0, F.lit("")).otherwise(F.lit("company")).alias("manufacturer_company_address"),
        F.lit("TW").alias("manufacturer_country"),
        key.alias("_k"),
    )
    active = base.where(F.col("_k") % 4 == 0).withColumn("cancel_status", F.lit("N")).drop("_k")
    return base.drop("_k"), active


@query(
    "curate_products",
    f"WITH {ITEMS_SQL} SELECT product_code, name_en, name_zh, ingredient_text, is_combo, CAST(s AS VARCHAR) AS start_date, CAST(e AS VARCHAR) AS end_date FROM products",
)
def _curate_products(spark: SparkSession, sf: str) -> DataFrame:
    products = C.current_products(raw_items(spark, sf), F.to_timestamp(F.lit("2026-01-01")))
    return products.select(
        "product_code", "name_en", "name_zh", "ingredient_text", "is_combo",
        F.col("effective_start").cast("string").alias("start_date"), F.col("effective_end").cast("string").alias("end_date"),
    )


@query(
    "curate_permits",
    """
    SELECT '部第' || lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '號' AS permit_no, s_suppkey % 4 <> 0 AND s_suppkey % 3 <> 0 AS is_cancelled,
        CASE WHEN s_suppkey % 2 = 0 THEN s_name ELSE '中文' END AS product_name,
        CASE WHEN s_suppkey % 5 = 0 THEN 'site' ELSE 'company' END AS manufacturer_address FROM supplier
    """,
)
def _curate_permits(spark: SparkSession, sf: str) -> DataFrame:
    lookup = C.permit_lookup(*raw_permits(spark, sf))
    permits = C.curated_permits(lookup, F.to_timestamp(F.lit("2026-01-01")))
    return permits.select("permit_no", "is_cancelled", "product_name", "manufacturer_address")


@query(
    "curate_links",
    f"WITH {ITEMS_SQL} SELECT product_code, '部第' || tail || '號' AS permit_no FROM products WHERE CAST(tail AS BIGINT) IN (SELECT s_suppkey FROM supplier)",
)
def _curate_links(spark: SparkSession, sf: str) -> DataFrame:
    products = C.current_products(raw_items(spark, sf), F.to_timestamp(F.lit("2026-01-01")))
    return C.link_permits(products, C.permit_lookup(*raw_permits(spark, sf)))


MENTIONS_SQL = f"""{ITEMS_SQL}, linked AS (SELECT product_code, s_suppkey FROM products JOIN supplier ON s_suppkey = CAST(tail AS BIGINT)),
    mentions AS (SELECT product_code, trim(unnest(string_split(ingredient_text, ' + '))) AS mention, 'nhi' AS source FROM products
        UNION ALL SELECT product_code, unnest(['red plate', 'Substance ' || s_suppkey]), 'tfda' FROM linked)"""


def curated_mentions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    products = C.current_products(raw_items(spark, sf), F.to_timestamp(F.lit("2026-01-01")))
    lookup = C.permit_lookup(*raw_permits(spark, sf))
    texts = C.link_permits(products, lookup).join(lookup.select("permit_no", "ingredient_text"), "permit_no")
    mentions = C.ingredient_mentions(products, "nhi").unionByName(C.ingredient_mentions(texts, "tfda", kind="permit"))
    return products, mentions


@query(
    "curate_concepts",
    f"""WITH {MENTIONS_SQL} SELECT {sql_norm('mention')} AS canonical_name_normalized, min(mention) AS canonical_name,
        {sql_uuid(sql_norm('mention'))} AS ingredient_id FROM mentions GROUP BY 1, 3""",
)
def _curate_concepts(spark: SparkSession, sf: str) -> DataFrame:
    return C.build_concepts(curated_mentions(spark, sf)[1])


@query(
    "curate_product_ingredients",
    f"WITH {MENTIONS_SQL} SELECT DISTINCT product_code, {sql_uuid(sql_norm('mention'))} AS ingredient_id, 'active' AS role, source FROM mentions",
)
def _curate_product_ingredients(spark: SparkSession, sf: str) -> DataFrame:
    return C.product_ingredients(curated_mentions(spark, sf)[1]).select("product_code", "ingredient_id", "role", "source")


@query(
    "curate_variants",
    f"""WITH {MENTIONS_SQL}, v AS (SELECT 'product' AS target_type, product_code AS target_id, 'zh' AS language, 'product_name_zh' AS variant_type, name_zh AS variant_text, 'item' AS source FROM products WHERE name_zh <> ''
        UNION ALL SELECT 'product', product_code, 'en', 'product_name_en', name_en, 'item' FROM products
        UNION ALL SELECT 'ingredient', {sql_uuid(sql_norm('mention'))}, 'en', 'ingredient_alias', mention, source FROM mentions),
    n AS (SELECT *, {sql_norm('variant_text')} AS normalized_text FROM v)
    SELECT target_type, target_id, normalized_text, source, arg_min(variant_text, (variant_type, variant_text)) AS variant_text,
        arg_min(language, (variant_type, variant_text)) AS language FROM n GROUP BY 1, 2, 3, 4""",
)
def _curate_variants(spark: SparkSession, sf: str) -> DataFrame:
    variants = C.name_variants(*curated_mentions(spark, sf))
    return variants.select("target_type", "target_id", "normalized_text", "source", "variant_text", "language")


@query(
    "derived_keys",
    f"SELECT p_partkey, {sql_name_key('n')} AS ocr_key_en, '' AS ocr_key_zh FROM (SELECT p_partkey, p_name || ' ' || p_size || '. 5 mg/tab' AS n FROM part)",
)
def _derived_keys(spark: SparkSession, sf: str) -> DataFrame:
    named = table(spark, sf, "part").select(
        "p_partkey",
        F.concat("p_name", F.lit(" "), F.col("p_size").cast("string"), F.lit(". 5 mg/tab")).alias("name_en"),
        F.lit(None).cast("string").alias("name_zh"),
    )
    return C.with_name_keys(named).select("p_partkey", "ocr_key_en", "ocr_key_zh")


@query(
    "latest_atc",
    """
    WITH a AS (SELECT c_mktsegment AS atc_code, CAST(o_orderdate AS DATE) AS snapshot_date, CAST(o_orderkey AS VARCHAR) AS atc_name FROM orders JOIN customer ON c_custkey = o_custkey)
    SELECT atc_code, CAST(max(snapshot_date) AS VARCHAR) AS snapshot_date, arg_max(atc_name, (snapshot_date, atc_name)) AS atc_name FROM a GROUP BY atc_code
    """,
)
def _latest_atc(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("atc_code"))
    atc = table(spark, sf, "orders").join(customer, "o_custkey").select(
        "atc_code", F.to_date("o_orderdate").alias("snapshot_date"), F.col("o_orderkey").cast("string").alias("atc_name")
    )
    return C.latest_atc(atc).select("atc_code", F.col("snapshot_date").cast("string").alias("snapshot_date"), "atc_name")


# --- interactions -------------------------------------------------------------------

SEVERITY_SQL = "CASE l_linenumber % 3 WHEN 0 THEN 'Major' WHEN 1 THEN 'moderate' ELSE 'MINOR' END"
NAME_MAP_SQL = """nm AS (SELECT 'N' || p_partkey AS drug_name, CASE WHEN p_partkey % 10 < 9 THEN 'I' || (p_partkey % 300) END AS ingredient_id FROM part)"""
PAIRS_SQL = f"""{NAME_MAP_SQL}, ends AS (SELECT a.ingredient_id AS ia, b.ingredient_id AS ib, lower({SEVERITY_SQL}) AS severity, l_returnflag, l_linestatus, l_linenumber
        FROM lineitem JOIN nm a ON a.drug_name = 'N' || l_partkey JOIN nm b ON b.drug_name = 'N' || (l_suppkey * 7)
        WHERE a.ingredient_id IS NOT NULL AND b.ingredient_id IS NOT NULL AND a.ingredient_id <> b.ingredient_id),
    srt AS (SELECT least(ia, ib) AS ingredient_a, greatest(ia, ib) AS ingredient_b, severity, l_returnflag, l_linestatus, l_linenumber FROM ends),
    src AS (SELECT ingredient_a, ingredient_b, string_agg(DISTINCT s, ';' ORDER BY s) AS sources FROM
        (SELECT ingredient_a, ingredient_b, unnest([l_returnflag, l_linestatus]) AS s FROM srt) GROUP BY 1, 2),
    folded AS (SELECT ingredient_a, ingredient_b, CASE max(CASE severity WHEN 'major' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) WHEN 3 THEN 'major' WHEN 2 THEN 'moderate' ELSE 'minor' END AS severity,
        CAST(sum(l_linenumber) AS BIGINT) AS raw_rows FROM srt GROUP BY 1, 2)"""


def name_map(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        F.concat(F.lit("N"), key.cast("string")).alias("drug_name"),
        F.when(key % 10 < 9, F.concat(F.lit("I"), (key % 300).cast("string"))).alias("ingredient_id"),
        (key * 37 % 1000).cast("int").alias("occurrences"),
        F.col("p_brand").alias("source_ids"),
        F.when(key % 10 < 9, "exact_canonical").otherwise("unmapped").alias("match_method"),
        F.lit(None).cast("string").alias("notes"),
    )


def raw_pairs(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("l_linenumber") % 3
    return table(spark, sf, "lineitem").select(
        F.concat(F.lit("N"), F.col("l_partkey").cast("string")).alias("drug_a"),
        F.concat(F.lit("N"), (F.col("l_suppkey") * 7).cast("string")).alias("drug_b"),
        F.when(step == 0, "Major").when(step == 1, "moderate").otherwise("MINOR").alias("severity"),
        F.concat("l_returnflag", F.lit("; "), "l_linestatus").alias("sources"),
        F.col("l_linenumber").cast("string").alias("raw_rows"),
    )


def folded_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return D.import_pairs(raw_pairs(spark, sf), name_map(spark, sf))


@query("pair_fold", f"WITH {PAIRS_SQL} SELECT ingredient_a, ingredient_b, severity, sources, raw_rows FROM folded JOIN src USING (ingredient_a, ingredient_b)")
def _pair_fold(spark: SparkSession, sf: str) -> DataFrame:
    return folded_pairs(spark, sf).select("ingredient_a", "ingredient_b", "severity", "sources", F.col("raw_rows").cast("long").alias("raw_rows"))


@query(
    "pair_import",
    f"""WITH {PAIRS_SQL}, old AS (SELECT 'I' || s_suppkey AS ingredient_a, 'I' || (s_suppkey + 1) AS ingredient_b, 'minor' AS severity FROM supplier)
    SELECT ingredient_a, ingredient_b, severity FROM folded UNION ALL SELECT * FROM old o WHERE NOT EXISTS
        (SELECT 1 FROM folded f WHERE f.ingredient_a = o.ingredient_a AND f.ingredient_b = o.ingredient_b)""",
)
def _pair_import(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("s_suppkey")
    old = table(spark, sf, "supplier").select(
        F.concat(F.lit("I"), key.cast("string")).alias("ingredient_a"),
        F.concat(F.lit("I"), (key + 1).cast("string")).alias("ingredient_b"),
        F.lit("minor").alias("severity"),
    )
    return K.upsert(old, folded_pairs(spark, sf), ["ingredient_a", "ingredient_b"]).select("ingredient_a", "ingredient_b", "severity")


@query(
    "pair_merge",
    f"""WITH {PAIRS_SQL}, old AS (SELECT least('I' || (s_suppkey % 300), 'I' || (s_suppkey % 299 + 1)) AS ingredient_a, greatest('I' || (s_suppkey % 300), 'I' || (s_suppkey % 299 + 1)) AS ingredient_b,
        CASE s_suppkey % 3 WHEN 0 THEN 'major' WHEN 1 THEN 'moderate' ELSE 'minor' END AS severity, 'old' AS s, s_suppkey AS raw_rows FROM supplier),
    every AS (SELECT ingredient_a, ingredient_b, severity, raw_rows FROM folded UNION ALL SELECT ingredient_a, ingredient_b, severity, raw_rows FROM old),
    names AS (SELECT ingredient_a, ingredient_b, unnest(string_split(sources, ';')) AS s FROM src UNION SELECT ingredient_a, ingredient_b, s FROM old),
    lists AS (SELECT ingredient_a, ingredient_b, string_agg(DISTINCT s, ';' ORDER BY s) AS sources FROM names GROUP BY 1, 2)
    SELECT ingredient_a, ingredient_b, CASE max(CASE severity WHEN 'major' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END) WHEN 3 THEN 'major' WHEN 2 THEN 'moderate' ELSE 'minor' END AS severity,
        any_value(sources) AS sources, CAST(sum(raw_rows) AS BIGINT) AS raw_rows FROM every JOIN lists USING (ingredient_a, ingredient_b) GROUP BY 1, 2""",
)
def _pair_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The import that merges with stored pairs instead of replacing them."""
    key = F.col("s_suppkey")
    one, two = (F.concat(F.lit("I"), k.cast("string")) for k in (key % 300, key % 299 + 1))
    old = table(spark, sf, "supplier").select(
        F.least(one, two).alias("ingredient_a"), F.greatest(one, two).alias("ingredient_b"),
        F.when(key % 3 == 0, "major").when(key % 3 == 1, "moderate").otherwise("minor").alias("severity"),
        F.lit("old").alias("sources"), key.cast("long").alias("raw_rows"),
    )
    merged = D.import_pairs(raw_pairs(spark, sf), name_map(spark, sf), old, merge_existing=True)
    return merged.select("ingredient_a", "ingredient_b", "severity", "sources", "raw_rows")


@query("severity_counts", f"WITH {PAIRS_SQL} SELECT s.severity, count(f.severity) AS n FROM (VALUES ('major'), ('moderate'), ('minor')) AS s(severity) LEFT JOIN folded f USING (severity) GROUP BY 1")
def _severity_counts(spark: SparkSession, sf: str) -> DataFrame:
    return D.severity_counts(folded_pairs(spark, sf))


@query("mapping_coverage", f"WITH {NAME_MAP_SQL} SELECT count(*) AS names, count(ingredient_id) AS mapped, printf('%.2f%%', count(ingredient_id) * 100.0 / count(*)) AS mapped_pct FROM nm")
def _mapping_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return D.mapping_coverage(name_map(spark, sf))


@query(
    "top_unmapped",
    """SELECT 'N' || p_partkey AS drug_name, CAST(p_partkey * 37 % 1000 AS INTEGER) AS occurrences, p_brand AS source_ids FROM part WHERE p_partkey % 10 = 9
    ORDER BY occurrences DESC, lower(drug_name), drug_name LIMIT 100""",
)
def _top_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    return D.top_unmapped(name_map(spark, sf))


TEMPLATE_TITLES_SQL = "CASE severity WHEN 'major' THEN 'High-risk interaction' WHEN 'moderate' THEN 'Use with caution' ELSE 'Minor interaction' END"


@query(
    "pair_interactions",
    f"""WITH {PAIRS_SQL}, s AS (SELECT DISTINCT l_orderkey AS case_id, 'I' || (l_partkey % 300) AS id FROM lineitem)
    SELECT a.case_id, ingredient_a, ingredient_b, severity, {TEMPLATE_TITLES_SQL} AS patient_title FROM folded
        JOIN s a ON a.id = ingredient_a JOIN s b ON b.id = ingredient_b AND b.case_id = a.case_id""",
)
def _pair_interactions(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("I"), (F.col("l_partkey") % 300).cast("string")).alias("ingredient_id")
    )
    found = D.interactions(sets, folded_pairs(spark, sf), D.severity_templates(spark))
    return found.select("case_id", "ingredient_a", "ingredient_b", "severity", "patient_title")


@query(
    "ranked_sort",
    f"""WITH {PAIRS_SQL}, s AS (SELECT DISTINCT l_orderkey AS case_id, 'I' || (l_partkey % 300) AS id FROM lineitem)
    SELECT a.case_id, ingredient_a, ingredient_b, severity, row_number() OVER (PARTITION BY a.case_id
        ORDER BY CASE severity WHEN 'major' THEN 3 WHEN 'moderate' THEN 2 ELSE 1 END DESC, ingredient_a, ingredient_b) AS place
    FROM folded JOIN s a ON a.id = ingredient_a JOIN s b ON b.id = ingredient_b AND b.case_id = a.case_id""",
)
def _ranked_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Every interaction of every case with its place in the order of severity."""
    sets = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("case_id"), F.concat(F.lit("I"), (F.col("l_partkey") % 300).cast("string")).alias("ingredient_id")
    )
    found = D.interactions(sets, folded_pairs(spark, sf), D.severity_templates(spark))
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(*D.by_severity()))
    return found.select("case_id", "ingredient_a", "ingredient_b", "severity", place.alias("place"))


CASES_SQL = f"""{PAIRS_SQL},
    owned AS (SELECT 'P' || p_partkey AS code, 'I' || (p_partkey % 300) AS id FROM part WHERE p_partkey % 7 > 0),
    concepts AS (SELECT DISTINCT id FROM owned WHERE right(id, 1) <> '3'),
    codes AS (SELECT l_orderkey AS case_id, 'P' || l_partkey AS code, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2),
    asked AS (SELECT DISTINCT l_orderkey AS case_id, 'I' || (l_suppkey % 50) AS id FROM lineitem WHERE l_returnflag = 'R'),
    raw AS (SELECT DISTINCT l_orderkey AS case_id, l_shipdate::VARCHAR AS t FROM lineitem WHERE l_returnflag = 'A' AND l_quantity > 45),
    wanted AS (SELECT case_id, id, min(pos) AS pos FROM (SELECT case_id, id, pos FROM codes JOIN owned USING (code) UNION ALL SELECT case_id, id, NULL FROM asked) GROUP BY 1, 2),
    checked AS (SELECT case_id, id FROM wanted WHERE id IN (SELECT id FROM concepts)),
    tally AS (SELECT case_id, 'c' AS k FROM checked
        UNION ALL SELECT case_id, 'u' FROM codes WHERE code NOT IN (SELECT code FROM owned)
        UNION ALL SELECT case_id, 'u' FROM wanted WHERE id NOT IN (SELECT id FROM concepts)
        UNION ALL SELECT case_id, 'u' FROM raw
        UNION ALL SELECT a.case_id, 'f' FROM folded JOIN checked a ON a.id = ingredient_a JOIN checked b ON b.id = ingredient_b AND b.case_id = a.case_id)"""


def evaluated_cases(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    lineitem, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    ident = lambda c: F.concat(F.lit("I"), c.cast("string"))
    case = F.col("l_orderkey").alias("case_id")
    codes = lineitem.select(case, F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("product_code"), F.col("l_linenumber").alias("position"))
    ids = lineitem.where(F.col("l_returnflag") == "R").select(case, ident(F.col("l_suppkey") % 50).alias("ingredient_id"))
    texts = lineitem.where((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 45)).select(case, F.col("l_shipdate").cast("string").alias("raw_text"))
    owned = part.where(F.col("p_partkey") % 7 > 0).select(
        F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("product_code"), ident(F.col("p_partkey") % 300).alias("ingredient_id")
    )
    concepts = owned.where(~F.col("ingredient_id").endswith("3")).select("ingredient_id").distinct().withColumn("canonical_name", F.col("ingredient_id"))
    return D.evaluate_cases(codes, ids, texts, owned, concepts, folded_pairs(spark, sf))


@query(
    "case_coverage",
    f"""WITH {CASES_SQL}, n AS (SELECT case_id, count(*) FILTER (k = 'c') AS checked_count, count(*) FILTER (k = 'u') AS unchecked_count, count(*) FILTER (k = 'f') AS interaction_count FROM tally GROUP BY case_id)
    SELECT *, CASE WHEN interaction_count > 0 THEN 'interactions' WHEN unchecked_count = 0 THEN 'none_found' ELSE 'incomplete' END AS state FROM n""",
)
def _case_coverage(spark: SparkSession, sf: str) -> DataFrame:
    found = evaluated_cases(spark, sf)
    return found["counts"].select("case_id", "checked_count", "unchecked_count", "interaction_count", "state")


@query(
    "case_checked",
    f"""WITH {CASES_SQL} SELECT case_id, id AS ingredient_id, id AS canonical_name,
        row_number() OVER (PARTITION BY case_id ORDER BY lower(id), id) AS place FROM checked""",
)
def _case_checked(spark: SparkSession, sf: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("case_id").orderBy(*D.by_name()))
    return evaluated_cases(spark, sf)["checked"].select("case_id", "ingredient_id", "canonical_name", place.alias("place"))


@query(
    "case_unchecked",
    f"""WITH {CASES_SQL}
    SELECT case_id, 'unknown_product' AS reason, NULL AS raw_text, code AS product_code FROM codes WHERE code NOT IN (SELECT code FROM owned)
    UNION ALL SELECT w.case_id, 'missing_ingredient_concept', w.id, (SELECT arg_min(code, (pos, code)) FROM codes c JOIN owned o USING (code) WHERE c.case_id = w.case_id AND o.id = w.id)
        FROM wanted w WHERE w.id NOT IN (SELECT id FROM concepts)
    UNION ALL SELECT case_id, 'unknown_product', t, NULL FROM raw""",
)
def _case_unchecked(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated_cases(spark, sf)["unchecked"].select("case_id", "reason", "raw_text", "product_code")


@query(
    "case_interactions",
    f"""WITH {CASES_SQL} SELECT a.case_id, ingredient_a, ingredient_b, severity
    FROM folded JOIN checked a ON a.id = ingredient_a JOIN checked b ON b.id = ingredient_b AND b.case_id = a.case_id""",
)
def _case_interactions(spark: SparkSession, sf: str) -> DataFrame:
    return evaluated_cases(spark, sf)["interactions"].select("case_id", "ingredient_a", "ingredient_b", "severity")


NAMES_SQL = f"""
    concepts AS (SELECT {sql_norm('p_name')} AS norm, 'C' || min(p_partkey) AS id FROM part GROUP BY 1 UNION ALL SELECT {sql_norm('p_name')}, 'D' FROM part WHERE p_name LIKE 'red %' GROUP BY 1),
    aliases AS (SELECT {sql_norm('p_brand')} AS norm, 'B' || (p_size % 2) AS id FROM part WHERE p_brand LIKE '%1' UNION SELECT {sql_norm('p_type')}, 'T' FROM part),
    names AS (SELECT DISTINCT p_name AS drug_name FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT lower(p_type) FROM part),
    c AS (SELECT norm, min(id) AS lo, max(id) AS hi FROM concepts GROUP BY norm), a AS (SELECT norm, min(id) AS lo, max(id) AS hi FROM aliases GROUP BY norm),
    auto AS (SELECT drug_name, CASE WHEN c.lo = c.hi THEN c.lo WHEN c.lo IS NULL AND a.lo = a.hi THEN a.lo END AS ingredient_id,
        CASE WHEN c.lo = c.hi THEN 'exact_canonical' WHEN c.lo IS NULL AND a.lo = a.hi THEN 'exact_alias' ELSE 'unmapped' END AS match_method
        FROM names LEFT JOIN c ON c.norm = {sql_norm('drug_name')} LEFT JOIN a ON a.norm = {sql_norm('drug_name')}),
    old AS (SELECT DISTINCT p_name AS drug_name, 'M' AS ingredient_id FROM part WHERE p_name LIKE '%plate')"""


def built_name_map(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    smallest = part.groupBy(T.normalize_text("p_name").alias("canonical_name_normalized")).agg(F.concat(F.lit("C"), F.min("p_partkey").cast("string")).alias("ingredient_id"))
    red = part.where(F.col("p_name").startswith("red ")).select(T.normalize_text("p_name").alias("canonical_name_normalized"), F.lit("D").alias("ingredient_id"))
    brand = part.where(F.col("p_brand").endswith("1")).select(
        T.normalize_text("p_brand").alias("normalized_text"), F.concat(F.lit("B"), (F.col("p_size") % 2).cast("string")).alias("ingredient_id")
    )
    kind = part.select(T.normalize_text("p_type").alias("normalized_text"), F.lit("T").alias("ingredient_id"))
    names = part.select(F.explode(F.array("p_name", "p_brand", F.lower("p_type"))).alias("drug_name")).distinct().withColumns(
        {"source_ids": F.lit(None).cast("string"), "occurrences": F.length("drug_name")}
    )
    existing = part.where(F.col("p_name").endswith("plate")).select(
        F.col("p_name").alias("drug_name"), F.lit("M").alias("ingredient_id"), F.lit("manual").alias("match_method"), F.lit("kept").alias("notes")
    ).distinct()
    return D.build_name_map(names, smallest.unionByName(red.distinct()), brand.unionByName(kind), existing)


@query("name_map", f"WITH {NAMES_SQL} SELECT drug_name, coalesce(old.ingredient_id, auto.ingredient_id) AS ingredient_id, CASE WHEN old.drug_name IS NOT NULL THEN 'manual' ELSE match_method END AS match_method FROM auto LEFT JOIN old USING (drug_name)")
def _name_map(spark: SparkSession, sf: str) -> DataFrame:
    return built_name_map(spark, sf).select("drug_name", "ingredient_id", "match_method")


@query(
    "manual_patch",
    f"""WITH {NAMES_SQL}, base AS (SELECT drug_name, coalesce(old.ingredient_id, auto.ingredient_id) AS ingredient_id, CASE WHEN old.drug_name IS NOT NULL THEN 'manual' ELSE match_method END AS match_method FROM auto LEFT JOIN old USING (drug_name)),
    patch AS (SELECT DISTINCT p_name AS drug_name FROM part UNION SELECT 'extra ' || s_name FROM supplier)
    SELECT drug_name, CASE WHEN p.drug_name IS NOT NULL AND b.ingredient_id IS NULL THEN 'X' ELSE b.ingredient_id END AS ingredient_id,
        CASE WHEN p.drug_name IS NOT NULL AND b.ingredient_id IS NULL THEN 'manual' ELSE match_method END AS match_method FROM base b FULL JOIN patch p USING (drug_name)""",
)
def _manual_patch(spark: SparkSession, sf: str) -> DataFrame:
    patches = table(spark, sf, "part").select(F.col("p_name").alias("drug_name")).distinct().unionByName(
        table(spark, sf, "supplier").select(F.concat(F.lit("extra "), "s_name").alias("drug_name"))
    ).withColumn("ingredient_id", F.lit("X"))
    return D.patch_name_map(built_name_map(spark, sf), patches).select("drug_name", "ingredient_id", "match_method")
