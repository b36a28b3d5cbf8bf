"""Text, number, date and id functions over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medlink.catalog.registry import (
    query, spread, sql_line_key, sql_norm, sql_norm_punct, sql_spacing, sql_stem, sql_tail, sql_uuid, table,
)
from medlink.functions import ingredients as I
from medlink.functions import ocr_text as O
from medlink.functions import text as T
from medlink.functions.case_fields import case_fields, text_lines
from medlink.operators import curate as C
from medlink.operators import matching as M

HAN = "[\\x{4E00}-\\x{9FFF}]"


@query("normalize_text", f"SELECT doc_id, {sql_norm('text')} AS normalized FROM documents")
def _normalize_text(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_text("text").alias("normalized"))


@query("normalize_text_sql", f"SELECT doc_id, {sql_norm_punct('text')} AS normalized FROM documents")
def _normalize_text_sql(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", T.normalize_text_sql("text").alias("normalized"))


@query(
    "parse_decimal",
    """
    WITH raw AS (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 7 WHEN 5 THEN ' - ' WHEN 6 THEN ''
        ELSE ' ' || format('{:,.2f}', l_extendedprice) END AS amount_text FROM lineitem)
    SELECT l_orderkey, l_linenumber, amount_text,
        CAST(nullif(nullif(replace(trim(amount_text), ',', ''), '-'), '') AS DOUBLE) AS amount FROM raw
    """,
)
def _parse_decimal(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("l_linenumber") % 7
    text = F.when(step == 5, " - ").when(step == 6, "").otherwise(
        F.concat(F.lit(" "), F.format_number("l_extendedprice", 2))
    )
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", text.alias("amount_text")).withColumn(
        "amount", T.parse_decimal("amount_text").cast("double")
    )


@query(
    "parse_roc_date",
    """
    WITH raw AS (SELECT o_orderkey, o_orderdate AS d, CASE o_orderkey % 5
        WHEN 0 THEN (year(o_orderdate) - 1911) || strftime(o_orderdate, '%m%d')
        WHEN 1 THEN (year(o_orderdate) - 1891) || strftime(o_orderdate, '%m%d')
        WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN strftime(o_orderdate, '%Y/%m/%d')
        ELSE strftime(o_orderdate, '%Y%m%d') END AS date_text FROM orders)
    SELECT o_orderkey, date_text, CASE WHEN regexp_matches(date_text, '^\\d{6,7}$')
        THEN (CAST(left(date_text, length(date_text) - 4) AS INTEGER) + 1911) || '-' ||
            substr(date_text, length(date_text) - 3, 2) || '-' || right(date_text, 2)
        ELSE strftime(d, '%Y-%m-%d') END AS parsed FROM raw
    """,
)
def _parse_roc_date(spark: SparkSession, sf: str) -> DataFrame:
    day, kind = F.col("o_orderdate"), F.col("o_orderkey") % 5
    short = lambda offset: F.concat((F.year(day) - offset).cast("string"), F.date_format(day, "MMdd"))
    text = (
        F.when(kind == 0, short(1911)).when(kind == 1, short(1891))
        .when(kind == 2, F.date_format(day, "yyyy-MM-dd")).when(kind == 3, F.date_format(day, "yyyy/MM/dd"))
        .otherwise(F.date_format(day, "yyyyMMdd"))
    )
    return table(spark, sf, "orders").select("o_orderkey", text.alias("date_text")).withColumn(
        "parsed", T.parse_date("date_text").cast("string")
    )


@query(
    "split_ingredients",
    """
    WITH raw AS (SELECT p_partkey, p_name || ' + ' || p_type || ' / ' || p_brand || ' and X;;' || p_type AS t,
        p_name || ' ;; ' || p_brand || ' ;;' AS u FROM part)
    SELECT p_partkey, array_to_string(list_filter(list_transform(
            regexp_split_to_array(t, '(?i)\\s*(?:;;|,|\\+|/| AND )\\s*'), lambda x: trim(x)), lambda x: x <> ''), '|') AS item_parts,
        array_to_string(list_filter(list_transform(string_split(u, ';;'), lambda x: trim(x)), lambda x: x <> ''), '|') AS permit_parts
    FROM raw
    """,
)
def _split_ingredients(spark: SparkSession, sf: str) -> DataFrame:
    item = F.concat("p_name", F.lit(" + "), "p_type", F.lit(" / "), "p_brand", F.lit(" and X;;"), "p_type")
    permit = F.concat("p_name", F.lit(" ;; "), "p_brand", F.lit(" ;;"))
    return table(spark, sf, "part").select(
        "p_partkey",
        F.array_join(T.split_item_ingredients(item), "|").alias("item_parts"),
        F.array_join(T.split_permit_ingredients(permit), "|").alias("permit_parts"),
    )


UNIT_SQL = "(?:MMOL|MEQ|MCG|MOL|MG|ML|IU|UG|GM|G|U|L|%)"
def strength_text() -> Column:
    return F.concat(
        "p_name",
        F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" MG/ML + ")))
        .when(F.col("p_partkey") % 3 == 1, F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(".5 mcg, ")))
        .otherwise(F.lit(" 12 ")),
        "p_type",
        F.lit(" ("),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("EQ TO "), F.col("p_brand"), F.lit(" OR B = C"))).otherwise(
            F.lit(" 5 MG ")
        ),
        F.lit(") IU"),
    )

STRENGTH_SQL = """p_name || CASE p_partkey % 3 WHEN 0 THEN ' ' || p_size || ' MG/ML + ' WHEN 1 THEN ' ' || p_size || '.5 mcg, '
    ELSE ' 12 ' END || p_type || ' (' || CASE p_partkey % 2 WHEN 0 THEN 'EQ TO ' || p_brand || ' OR B = C' ELSE ' 5 MG ' END || ') IU'"""


def sql_strip_strength(e: str) -> str:
    """Strength removal for texts with at most one pair of parentheses."""
    marked = f"regexp_replace(regexp_replace({e}, '\\(\\s*=\\s*', '('), '(?i)\\(\\s*EQ\\s+TO\\s+', '(')"
    inner = f"regexp_extract({marked}, '\\(([^()]*)\\)', 1)"
    inner = f"regexp_replace(regexp_replace({inner}, '\\s*=\\s*', ' ; ', 'g'), '(?i)\\s+OR\\s+', ' ; ', 'g')"
    inner = f"trim(regexp_replace({inner}, '\\s+', ' ', 'g'), ' ;')"
    note = f"CASE WHEN {inner} = '' THEN '' ELSE '(' || {inner} || ')' END"
    out = (
        f"CASE WHEN contains({marked}, '(') THEN regexp_extract({marked}, '^([^(]*)\\(', 1) || {note} ||"
        f" regexp_extract({marked}, '\\)(.*)$', 1) ELSE {marked} END"
    )
    out = f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"
    for pattern in (
        rf"(?i)\b\d+(?:\.\d+)?\s*{UNIT_SQL}(?:\s*/\s*{UNIT_SQL})+",
        rf"(?i)\b\d+(?:\.\d+)?\s*{UNIT_SQL}\b",
        r"\b\d+(?:\.\d+)?\b",
        rf"(?i)\b{UNIT_SQL}\b",
        r"\(\s*\)",
    ):
        out = f"regexp_replace({out}, '{pattern}', ' ', 'g')"
    return f"trim(trim(regexp_replace({out}, '\\s+', ' ', 'g')), '+,/; ')"


@query(
    "strip_strength",
    f"WITH raw AS (SELECT p_partkey, {STRENGTH_SQL} AS t FROM part) SELECT p_partkey, {sql_strip_strength('t')} AS stripped FROM raw",
)
def _strip_strength(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", I.strip_strength(strength_text()).alias("stripped"))


def compare_text() -> Column:
    return (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("DL-"), F.col("p_name"), F.lit(" (HCL) 100 MG")))
        .when(F.col("p_partkey") % 6 == 1, F.concat(F.col("p_name"), F.lit(" (2HCL MONOHYDRATE) 5 MG")))
        .when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("sulpyrin "), F.col("p_name")))
        .when(F.col("p_partkey") % 6 == 3, F.concat(F.col("p_name"), F.lit(" di-hcl ("), F.col("p_type"), F.lit(" OR X)")))
        .when(F.col("p_partkey") % 6 == 4, F.lit("HYOSCINE-N-BUTYLBROMIDE"))
        .otherwise(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_brand"), F.lit(" Sodium)")))
    )

COMPARE_SQL = """CASE p_partkey % 6 WHEN 0 THEN 'DL-' || p_name || ' (HCL) 100 MG' WHEN 1 THEN p_name || ' (2HCL MONOHYDRATE) 5 MG'
    WHEN 2 THEN 'sulpyrin ' || p_name WHEN 3 THEN p_name || ' di-hcl (' || p_type || ' OR X)' WHEN 4 THEN 'HYOSCINE-N-BUTYLBROMIDE'
    ELSE p_name || ' (' || p_brand || ' Sodium)' END"""
SALTS_SQL = (
    "HCL|HBR|SODIUM|POTASSIUM|CALCIUM|MAGNESIUM|PHOSPHATE|SULFATE|NITRATE|ACETATE|CITRATE|TARTRATE|MONOHYDRATE|DIHYDRATE"
    "|HYDRATE|ESTOLATE|SUCCINATE|MALEATE|FUMARATE|BESYLATE|MESYLATE|TOSYLATE|GLUCONATE|CHLORIDE"
)


def sql_compare_key(e: str) -> str:
    out = f"regexp_replace({e}, '(?i)(^|[^A-Z0-9])DL\\s*-\\s*', '\\1', 'g')"
    out = f"trim(regexp_replace({out}, '\\s+', ' ', 'g'), ' -')"
    out = f"regexp_replace({out}, '(?i)\\bDI\\s*-?\\s*HCL\\b', '2HCL', 'g')"
    out = f"regexp_replace({out}, '(?i)\\b2\\s*HCL\\b', '2HCL', 'g')"
    out = f"regexp_replace({out}, '(?i)\\b2HCL(?:\\s+(?:MONOHYDRATE|DIHYDRATE|HYDRATE))\\b', '2HCL', 'g')"
    return sql_norm(out)


ALIASES_SQL = """(VALUES ('ETHYLPHENYLEPHRINE','ETHYLPHENYLEPHRINE'), ('ETILEFRIN','ETHYLPHENYLEPHRINE'),
    ('ETILEFRINE','ETHYLPHENYLEPHRINE'), ('DIPYRONE','DIPYRONE'), ('SULPYRIN','DIPYRONE'), ('SULPYRINE','DIPYRONE'),
    ('BUTYLSCOPOLAMINE','BUTYLSCOPOLAMINE'), ('HYOSCINE N BUTYLBROMIDE','BUTYLSCOPOLAMINE'),
    ('BUTYLSCOPOLAMINE BROMIDE','BUTYLSCOPOLAMINE')) AS a(alias, canonical)"""


@query(
    "compare_tokens",
    f"""
    WITH raw AS (SELECT p_partkey, {COMPARE_SQL} AS t FROM part),
    clean AS (SELECT p_partkey, {sql_strip_strength('t')} AS c FROM raw),
    cut AS (SELECT p_partkey, c, trim(split_part(c, '(', 1)) AS root,
        trim(regexp_extract(c, '^([^()]+?)\\s*\\(([^()]+)\\)\\s*$', 1)) AS r,
        trim(regexp_extract(c, '^([^()]+?)\\s*\\(([^()]+)\\)\\s*$', 2)) AS n FROM clean),
    flat AS (SELECT p_partkey, c, root, CASE WHEN r <> '' AND {sql_norm('n')} <> '' AND length({sql_norm('n')}) <= 30
            AND regexp_matches(upper(n), '^[A-Z0-9 -]+$') AND regexp_matches({sql_norm('n')}, '(?i)\\b(?:{SALTS_SQL})\\b')
        THEN trim(r || ' ' || {sql_norm('n')}) ELSE c END AS f FROM cut),
    keys AS (SELECT p_partkey, {sql_compare_key("CASE WHEN root <> '' THEN root ELSE c END")} AS k FROM flat
        UNION SELECT p_partkey, {sql_compare_key('f')} FROM flat WHERE f <> c),
    hits AS (SELECT p_partkey, k, a.canonical || substr(k, length(a.alias) + 1) AS m,
        row_number() OVER (PARTITION BY p_partkey, k ORDER BY length(a.alias) DESC) AS rn
        FROM keys LEFT JOIN {ALIASES_SQL} ON k = a.alias OR starts_with(k, a.alias || ' ') WHERE k <> '')
    SELECT p_partkey, string_agg(DISTINCT coalesce(m, k), '|' ORDER BY coalesce(m, k)) AS tokens FROM hits WHERE rn = 1
    GROUP BY p_partkey
    """,
)
def _compare_tokens(spark: SparkSession, sf: str) -> DataFrame:
    tokens = F.array_join(F.array_sort(I.compare_tokens(compare_text())), "|")
    return table(spark, sf, "part").select("p_partkey", tokens.alias("tokens"))


PLANTED_ALIASES = [("STANDARD", "NORMAL"), ("STANDARD RED", "NORMAL CRIMSON"), ("PROMO", "OFFER"), ("ECONOMY HOT", "THRIFT")]
PLANTED_ALIASES_SQL = (
    "(VALUES ('STANDARD','NORMAL'),('STANDARD RED','NORMAL CRIMSON'),('PROMO','OFFER'),('ECONOMY HOT','THRIFT')) AS a(alias, canonical)"
)
ALIAS_HITS_SQL = f"""
    WITH tok AS (SELECT p_partkey, {sql_norm("p_type || ' ' || p_name")} AS token FROM part),
    hits AS (SELECT p_partkey, token, alias, canonical,
        row_number() OVER (PARTITION BY p_partkey ORDER BY length(alias) DESC) AS rn
        FROM tok LEFT JOIN {PLANTED_ALIASES_SQL} ON token = alias OR starts_with(token, alias || ' '))"""


@query(
    "alias_map",
    ALIAS_HITS_SQL + " SELECT p_partkey, token, coalesce(canonical || substr(token, length(alias) + 1), token) AS mapped, alias AS alias_used FROM hits WHERE rn = 1",
)
def _alias_map(spark: SparkSession, sf: str) -> DataFrame:
    aliases = spark.createDataFrame(PLANTED_ALIASES, "alias string, canonical string")
    tokens = table(spark, sf, "part").select(
        "p_partkey", T.normalize_text(F.concat_ws(" ", "p_type", "p_name")).alias("token")
    )
    return C.map_aliases(tokens, "token", aliases)


@query(
    "alias_usage",
    ALIAS_HITS_SQL + " SELECT canonical, count(*) AS uses FROM hits WHERE rn = 1 AND canonical IS NOT NULL GROUP BY canonical",
)
def _alias_usage(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "part").select(T.normalize_text(F.concat_ws(" ", "p_type", "p_name")).alias("token"))
    return C.alias_usage(tokens, "token", dict(PLANTED_ALIASES))


@query(
    "plural_stem",
    f"""
    WITH w AS (SELECT DISTINCT unnest(string_split({sql_norm('text')}, ' ')) AS word FROM documents)
    SELECT word, {sql_stem('word')} AS stem FROM w WHERE length(word) >= 2
    """,
)
def _plural_stem(spark: SparkSession, sf: str) -> DataFrame:
    words = table(spark, sf, "documents").select(F.explode(T.words(T.normalize_text("text"))).alias("word")).distinct()
    return words.withColumn("stem", T.plural_stem("word"))


def cjk_lead() -> Column:
    return F.when(F.col("doc_id") % 3 == 0, F.lit("药剂胶囊 ")).when(F.col("doc_id") % 3 == 1, F.lit("")).otherwise(F.lit("錠"))

CJK_LEAD_SQL = "CASE doc_id % 3 WHEN 0 THEN '药剂胶囊 ' WHEN 1 THEN '' ELSE '錠' END"


@query(
    "language_tag",
    f"""
    WITH t AS (SELECT doc_id, {CJK_LEAD_SQL} || CASE WHEN doc_id % 6 = 0 THEN '' ELSE text END AS t FROM documents)
    SELECT doc_id, CASE WHEN regexp_matches(t, '{HAN}') AND regexp_matches(t, '[A-Za-z]') THEN 'mixed'
        WHEN regexp_matches(t, '{HAN}') THEN 'zh' ELSE 'en' END AS language FROM t
    """,
)
def _language_tag(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(cjk_lead(), F.when(F.col("doc_id") % 6 == 0, F.lit("")).otherwise(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", T.language_tag(text).alias("language"))


@query(
    "cjk_extract",
    f"""
    SELECT doc_id, regexp_matches({CJK_LEAD_SQL} || text, '{HAN}') AS has_cjk,
        trim(regexp_replace({CJK_LEAD_SQL} || text || '錠', '[^\\x{{4E00}}-\\x{{9FFF}}]+', ' ', 'g')) AS cjk FROM documents
    """,
)
def _cjk_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        T.has_cjk(F.concat(cjk_lead(), "text")).alias("has_cjk"),
        T.extract_cjk(F.concat(cjk_lead(), "text", F.lit("錠"))).alias("cjk"),
    )


@query(
    "cjk_normalize",
    f"""
    SELECT doc_id, translate({CJK_LEAD_SQL} || text, '药剂胶门', '藥劑膠門') AS extended,
        translate({CJK_LEAD_SQL} || text, '药门', '藥門') AS basic FROM documents
    """,
)
def _cjk_normalize(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(cjk_lead(), "text")
    return table(spark, sf, "documents").select(
        "doc_id", T.normalize_cjk(text).alias("extended"), T.normalize_cjk(text, extended=False).alias("basic")
    )


@query(
    "cjk_near",
    f"""
    WITH n AS (SELECT DISTINCT p_name, CASE length(p_name) % 3 WHEN 0 THEN '糖倍平膜衣錠' WHEN 1 THEN '糖平膜衣錠' ELSE '止痛膠囊' END AS zh FROM part),
    s AS (SELECT DISTINCT c_mktsegment, CASE length(c_mktsegment) % 3 WHEN 0 THEN '糖倍平' WHEN 1 THEN '止痛錠' ELSE '膜衣錠' END AS seg FROM customer)
    SELECT p_name, c_mktsegment, contains(zh, seg) OR len(list_filter(range(1, length(seg) + 1),
        lambda i: contains(zh, left(seg, CAST(i AS INTEGER) - 1) || substr(seg, CAST(i AS INTEGER) + 1)))) > 0 AS near
    FROM n JOIN s ON length(p_name) % 2 = length(c_mktsegment) % 2
    """,
)
def _cjk_near(spark: SparkSession, sf: str) -> DataFrame:
    size = F.length("p_name")
    zh = F.when(size % 3 == 0, "糖倍平膜衣錠").when(size % 3 == 1, "糖平膜衣錠").otherwise("止痛膠囊")
    names = table(spark, sf, "part").select("p_name", zh.alias("zh"), (size % 2).alias("k")).distinct()
    size = F.length("c_mktsegment")
    seg = F.when(size % 3 == 0, "糖倍平").when(size % 3 == 1, "止痛錠").otherwise("膜衣錠")
    segs = table(spark, sf, "customer").select("c_mktsegment", seg.alias("seg"), (size % 2).alias("k")).distinct()
    return names.join(segs, "k").select("p_name", "c_mktsegment", T.cjk_near_match("seg", "zh").alias("near"))


@query(
    "concept_uuid5",
    f"""
    SELECT {sql_norm('p_name')} AS canonical_name_normalized, min(trim(p_name)) AS canonical_name,
        {sql_uuid(sql_norm('p_name'))} AS ingredient_id FROM part GROUP BY 1, 3
    """,
)
def _concept_uuid5(spark: SparkSession, sf: str) -> DataFrame:
    return C.build_concepts(table(spark, sf, "part").select(F.col("p_name").alias("mention")))


def noisy() -> Column:
    return F.concat(
        F.when(F.col("l_linenumber") % 4 == 1, F.lit("十全")).otherwise(F.lit("")),
        "p_name",
        F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit(" "), F.col("l_quantity").cast("int").cast("string"), F.lit(". 5 mg tab 總量 3盒")))
        .when(F.col("l_linenumber") % 4 == 1, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit("m XYZ")))
        .when(F.col("l_linenumber") % 4 == 2, F.concat(F.lit(" ("), F.col("p_type"), F.lit(") 2. "), F.col("p_brand")))
        .otherwise(F.lit(" PLATE, 總量 12 盒裝 end")),
    )

NOISY_SQL = """CASE WHEN l_linenumber % 4 = 1 THEN '十全' ELSE '' END || p_name || CASE l_linenumber % 4
    WHEN 0 THEN ' ' || CAST(l_quantity AS INTEGER) || '. 5 mg tab 總量 3盒' WHEN 1 THEN CAST(l_quantity AS INTEGER) || 'm XYZ'
    WHEN 2 THEN ' (' || p_type || ') 2. ' || p_brand ELSE ' PLATE, 總量 12 盒裝 end' END"""
NOISY_FROM = "lineitem JOIN part ON l_partkey = p_partkey"


def noisy_lines(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", F.col("l_partkey").alias("p_partkey"))
    parts = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    return lines.join(parts, "p_partkey").select("l_orderkey", "l_linenumber", "p_partkey", noisy().alias("line"))


@query(
    "dosage_tail",
    f"WITH n AS (SELECT l_orderkey, l_linenumber, p_partkey, {NOISY_SQL} AS line FROM {NOISY_FROM}) SELECT l_orderkey, l_linenumber, p_partkey, {sql_tail('line')} AS stripped FROM n",
)
def _dosage_tail(spark: SparkSession, sf: str) -> DataFrame:
    return noisy_lines(spark, sf).select("l_orderkey", "l_linenumber", "p_partkey", O.strip_dosage_tail("line").alias("stripped"))


@query(
    "ocr_spacing",
    f"""WITH n AS (SELECT l_orderkey, l_linenumber, p_partkey, replace({NOISY_SQL}, '十全', '') AS line FROM {NOISY_FROM})
    SELECT l_orderkey, l_linenumber, p_partkey, {sql_spacing('line')} AS spaced, {sql_line_key('line')} AS line_key FROM n""",
)
def _ocr_spacing(spark: SparkSession, sf: str) -> DataFrame:
    lines = noisy_lines(spark, sf).withColumn("line", F.replace("line", F.lit("十全"), F.lit("")))
    return lines.select(
        "l_orderkey", "l_linenumber", "p_partkey", O.ocr_spacing("line").alias("spaced"), O.line_key("line").alias("line_key")
    )


def sql_ocr_clean(e: str, tokens: str) -> str:
    """Full clean-up as a scalar expression; ``tokens`` is a one-column table of known tokens."""
    head = f"regexp_replace(regexp_replace({e}, '^\\p{{Han}}+', ''), '\\([^()]*\\)', '', 'g')"
    last = f"upper(list_extract(string_split(trim({head}), ' '), -1))"
    code = (
        f"len(string_split(trim({head}), ' ')) >= 2 AND length({last}) BETWEEN 2 AND 4"
        f" AND regexp_matches({last}, '^[A-Z0-9]+$') AND {last} NOT IN (SELECT token FROM {tokens})"
    )
    out = f"CASE WHEN {code} THEN trim(left({head}, greatest(length({head}) - length({last}) - 1, 0))) ELSE {head} END"
    out = f"regexp_replace({out}, '([a-zA-Z])(\\d)', '\\1 \\2', 'g')"
    out = f"regexp_replace({out}, '(?is)\\s+\\d+(\\.\\d+)?\\s*(mcg|mg|g|ml|iu|%|tab|cap|bot|puff|puffs)\\b.*$', '')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


TOKENS_SQL = f"SELECT DISTINCT unnest(string_split({sql_norm('p_name')}, ' ')) AS token FROM part"


@query(
    "ocr_clean",
    f"""
    WITH tok AS ({TOKENS_SQL}), n AS (SELECT DISTINCT {NOISY_SQL} AS line FROM {NOISY_FROM})
    SELECT line AS input_text, {sql_ocr_clean('line', 'tok')} AS cleaned FROM n
    """,
)
def _ocr_clean(spark: SparkSession, sf: str) -> DataFrame:
    texts = M.distinct_texts(noisy_lines(spark, sf).withColumnRenamed("line", "input_text"))
    tokens = table(spark, sf, "part").select(F.explode(T.words(T.normalize_text("p_name"))).alias("token"))
    return M.ocr_cleaned(texts, tokens)


@query(
    "permit_token",
    """
    WITH u AS (SELECT page_id, CASE page_id % 4
        WHEN 0 THEN regexp_extract(url, '^[^?#]*') || '?x=1&licId=' || page_id || '%E8%97%A5&y=2'
        WHEN 1 THEN regexp_extract(url, '^[^?#]*') || '/%E8%A1%9B%E7%BD%B2%E5%AD%97%E7%AC%AC' || page_id || '%E8%99%9F?z=1'
        ELSE url END AS url FROM pages)
    SELECT page_id, CASE page_id % 4 WHEN 0 THEN page_id || '藥' WHEN 1 THEN '衛署字第' || page_id || '號'
        ELSE nullif(trim(list_extract(string_split(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), -1)), '') END AS permit_token
    FROM u
    """,
)
def _permit_token(spark: SparkSession, sf: str) -> DataFrame:
    base, key, kind = F.regexp_extract("url", "^[^?#]*", 0), F.col("page_id").cast("string"), F.col("page_id") % 4
    url = (
        F.when(kind == 0, F.concat(base, F.lit("?x=1&licId="), key, F.lit("%E8%97%A5&y=2")))
        .when(kind == 1, F.concat(base, F.lit("/%E8%A1%9B%E7%BD%B2%E5%AD%97%E7%AC%AC"), key, F.lit("%E8%99%9F?z=1")))
        .otherwise(F.col("url"))
    )
    return table(spark, sf, "pages").select("page_id", T.permit_token(url).alias("permit_token"))


DOC_LINES_SQL = """lines AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) - 1 AS line_no
    FROM (SELECT doc_id, regexp_split_to_array(text, '\\r?\\n') AS a FROM documents))"""


def document_lines(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents")).select("doc_id", F.posexplode(text_lines("text")).alias("line_no", "line"))


DOSAGE_SQL = "regexp_matches({l}, '(?i)\\b\\d+(?:\\.\\d+)?\\s*(mg|mcg|g|ml|iu|%)\\b')"
PUFF_SQL = "regexp_matches({l}, '(?i)\\b(?:puff|puffs)\\b|\\b\\d+\\s*puff\\b')"
FORM_SQL = "(regexp_matches({l}, '(?i)\\b(tab|tablet|cap|capsule|syrup|inj|inhal|spray|solution|susp|respimat)\\b|滴眼|錠|膠囊|口服|吸入|噴霧|注射|溶液|懸浮') OR " + PUFF_SQL + ")"
HINT_SQL = "regexp_matches({l}, '\\(([A-Za-z][^)]+)\\)')"
BOILER_SQL = "regexp_matches({l}, '(?i)\\b(prescription|quantity|dispensing|pharmacist|physician|warnings|warning|side effects|instruction|appearance|use before)\\b|領藥號|總量|用法|用途|外觀|警語|副作用|處方期限|調劑日期|藥師|醫師')"
PHONE_SQL = "regexp_matches({l}, '(?:\\b\\d{{2,3}}\\d{{6,}}\\b|\\b\\d{{2,4}}-\\d{{3,4}}-\\d{{3,4}}\\b|^\\d{{3,}}$)')"
def planted_line() -> Column:
    return F.concat(
        "line",
        F.when(F.col("line_no") % 5 == 0, F.lit(" 20mg Tab")).when(F.col("line_no") % 5 == 1, F.lit(" (Abc) 60 puff")).otherwise(F.lit("")),
    )

PLANTED_LINE_SQL = "line || CASE line_no % 5 WHEN 0 THEN ' 20mg Tab' WHEN 1 THEN ' (Abc) 60 puff' ELSE '' END"
PLANTED_LINES_SQL = f"WITH {DOC_LINES_SQL}, p AS (SELECT doc_id, line_no, {PLANTED_LINE_SQL} AS l FROM lines)"


@query(
    "line_predicates",
    f"""
    {PLANTED_LINES_SQL}, t AS (SELECT doc_id, line_no, l, {DOSAGE_SQL.format(l='l')} AS has_dosage, {FORM_SQL.format(l='l')} AS has_form,
        {HINT_SQL.format(l='l')} AS has_hint, {BOILER_SQL.format(l='l')} AS boiler, {PHONE_SQL.format(l='l')} AS phone FROM p),
    k AS (SELECT *, phone OR boiler OR (length(l) < 4 AND NOT has_dosage) AS hard_noise,
        has_dosage OR has_form OR has_hint OR (regexp_matches(l, '[A-Za-z]') AND regexp_matches(l, '\\d')) AS keep FROM t)
    SELECT doc_id, line_no, has_dosage, has_form, has_hint, hard_noise, keep,
        NOT hard_noise AND (regexp_matches(l, '[A-Za-z]') OR keep) AS name_line FROM k
    """,
)
def _line_predicates(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).withColumn("l", planted_line())
    return lines.select("doc_id", "line_no", F.inline(F.array(O.line_tests("l"))))


@query(
    "line_confidence",
    f"""
    {PLANTED_LINES_SQL} SELECT doc_id, line_no, least(50 + CASE WHEN {DOSAGE_SQL.format(l='l')} THEN 20 ELSE 0 END
        + CASE WHEN {FORM_SQL.format(l='l')} THEN 20 ELSE 0 END
        + CASE WHEN {PUFF_SQL.format(l='l')} AND NOT {DOSAGE_SQL.format(l='l')} THEN 20 ELSE 0 END
        + CASE WHEN {HINT_SQL.format(l='l')} THEN 10 ELSE 0 END, 95) / 100.0::DOUBLE AS confidence FROM p
    """,
)
def _line_confidence(spark: SparkSession, sf: str) -> DataFrame:
    lines = document_lines(spark, sf).withColumn("l", planted_line())
    return lines.select("doc_id", "line_no", O.line_confidence("l").alias("confidence"))


@query(
    "line_clean",
    f"""
    WITH {DOC_LINES_SQL}, p AS (SELECT doc_id, line_no, '* ' || line || ',, m c g 1O mg paff' AS l FROM lines),
    a AS (SELECT doc_id, line_no, regexp_replace(trim(regexp_replace(l, '\\s+', ' ', 'g')), '^[*•·\\-–—]+\\s*', '') AS l FROM p),
    b AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(l, '([.,;:])[.,;:]+', '\\1', 'g'),
        '(?i)\\bm\\s*c\\s*g\\b', 'mcg', 'g'), '(?i)\\bpaff\\b', 'puff', 'g') AS l FROM a)
    SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(l, '1O mg puff$', '10 mg puff'), '\\s+', ' ', 'g')) AS cleaned FROM b
    """,
)
def _line_clean(spark: SparkSession, sf: str) -> DataFrame:
    line = F.concat(F.lit("* "), "line", F.lit(",, m c g 1O mg paff"))
    return document_lines(spark, sf).select("doc_id", "line_no", O.pre_clean_line(line).alias("cleaned"))


@query(
    "response_json",
    """
    WITH r AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events)
    SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE k END AS k,
        CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type || ' x' END AS name FROM r
    """,
)
def _response_json(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(
        F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(', "name":"'), F.col("event_type"), F.lit('\nx"}')
    )
    kind = F.col("event_id") % 5
    stored = (
        F.when(kind == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```")))
        .when(kind == 1, F.concat(F.lit("<think>no {brace}</think>\n"), body))
        .when(kind == 2, F.concat(F.lit("<think>open thought\n"), body))
        .when(kind == 3, body)
        .otherwise(F.lit("not json"))
    )
    parsed = T.parse_response(stored, "k string, name string")
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), parsed["name"].alias("name"))


@query(
    "scalar_misc",
    f"""
    SELECT c_custkey, nullif(trim('  ' || c_mktsegment || ' '), '') AS cleaned,
        c_custkey % 4 IN (0, 1) AS combo, c_custkey % 3 = 2 AS cancelled,
        trim(regexp_replace(c_name || '   ' || c_mktsegment, '\\s+', ' ', 'g')) AS canonical,
        CASE WHEN c_custkey % 5 = 0 THEN '0.00%' ELSE printf('%.2f%%', c_nationkey * 100.0 / (c_custkey % 5)) END AS pct,
        CASE c_custkey % 3 WHEN 0 THEN 'a;b;c' WHEN 1 THEN 'b' ELSE NULL END AS sources,
        lower(trim(CASE c_custkey % 3 WHEN 0 THEN ' Major' WHEN 1 THEN 'MINOR ' ELSE 'moderate' END)) AS severity,
        CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS paren_text,
        '{{"c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}}' AS payload
    FROM customer
    """,
)
def _scalar_misc(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    flag = F.when(key % 4 == 0, "複方").when(key % 4 == 1, " yes ").when(key % 4 == 2, "單方").otherwise(None)
    status = F.when(key % 3 == 0, "未註銷").when(key % 3 == 1, " ").otherwise("已註銷")
    sources = F.when(key % 3 == 0, "c; a;b;a;").when(key % 3 == 1, " b ").otherwise(";")
    severity = F.when(key % 3 == 0, " Major").when(key % 3 == 1, "MINOR ").otherwise("moderate")
    customer = table(spark, sf, "customer")
    return customer.select(
        "c_custkey",
        T.clean_text(F.concat(F.lit("  "), "c_mktsegment", F.lit(" "))).alias("cleaned"),
        T.is_combo(flag).alias("combo"),
        T.is_cancelled(status).alias("cancelled"),
        T.canonical_name(F.concat("c_name", F.lit("   "), "c_mktsegment")).alias("canonical"),
        T.percent_text(F.col("c_nationkey"), key % 5).alias("pct"),
        T.source_list(sources).alias("sources"),
        T.severity_name(severity).alias("severity"),
        T.paren_slice(
            F.when(key % 2 == 0, F.concat(F.lit("x("), "c_mktsegment", F.lit(") y)"))).otherwise(F.lit(") no ("))
        ).alias("paren_text"),
        T.row_payload(customer.select("c_name", "c_nationkey")).alias("payload"),
    )


def _spacing_pass(source: str, name: str) -> str:
    """One left-to-right pass: two plain fragments become one unless too long together or both of five letters or more."""
    plain = "regexp_full_match({0}, '[A-Za-z]{{2,}}') AND lower({0}) NOT IN ('mg', 'ml', 'mcg', 'g', 'iu', 'kg', 'cm', 'mm')"
    return f"""{name} AS (SELECT doc_id, line_no, r.done || r.word || r.space AS t FROM (SELECT doc_id, line_no, list_reduce(
        list_prepend({{'done': regexp_extract(t, '^\\s*'), 'word': '', 'space': ''}}, list_transform(regexp_extract_all(t, '\\S+\\s*'),
            lambda x: {{'done': '', 'word': regexp_extract(x, '^\\S+'), 'space': regexp_extract(x, '\\s*$')}})),
        lambda s, c: CASE WHEN {plain.format('s.word')} AND {plain.format('c.word')} AND length(s.word) + length(c.word) <= 20 AND NOT (length(s.word) >= 5 AND length(c.word) >= 5)
            THEN {{'done': s.done || s.word || c.word || c.space, 'word': '', 'space': ''}}
            ELSE {{'done': s.done || s.word || s.space, 'word': c.word, 'space': c.space}} END) AS r FROM {source}))"""


SPACING_SQL = f"""WITH l AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM documents),
    p0 AS (SELECT doc_id, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS t FROM l),
    {_spacing_pass('p0', 'p1')}, {_spacing_pass('p1', 'p2')}, {_spacing_pass('p2', 'p3')},
    f AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '(?i)Warnings\\s*&\\s*Precaut\\s+ions', 'Warnings & Precautions', 'g'),
        '(?i)Precaut\\s+ions', 'Precautions', 'g'), '(?i)Physiciam', 'Physician', 'g'), '(?i)Pharmaci\\s+st', 'Pharmacist', 'g') AS spaced FROM p3)
    SELECT doc_id, line_no, spaced, lower(spaced) AS detection FROM f"""


@query("english_spacing", SPACING_SQL)
def _english_spacing(spark: SparkSession, sf: str) -> DataFrame:
    return document_lines(spark, sf).select(
        "doc_id", "line_no", O.english_spacing("line").alias("spaced"), O.detection_form("line").alias("detection")
    )


def quantity_text() -> Column:
    return F.concat(
        "p_name",
        F.when(F.col("p_partkey") % 4 == 0, F.lit("，總量 3 盒")).when(F.col("p_partkey") % 4 == 1, F.lit(", quantity 12 tabs"))
        .when(F.col("p_partkey") % 4 == 2, F.lit(" 總量5包裝  end")).otherwise(F.lit("  x")),
    )



@query(
    "quantity_strip",
    f"""
    SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name WHEN 2 THEN p_name || '裝 end' ELSE p_name || ' x' END AS stripped,
        p_partkey % 3 <> 2 AS quantity_only,
        CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE 'x ' || p_name END AS headless,
        p_partkey % 2 = 0 AS label_noise FROM part
    """,
)
def _quantity_strip(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    only = F.when(key % 3 == 0, F.concat(F.col("p_size").cast("string"), F.lit(" 盒"))).when(key % 3 == 1, "2瓶").otherwise("2 mg")
    header = F.when(key % 4 == 0, F.concat(F.lit("Medication  "), F.col("p_name"))).when(
        key % 2 == 0, F.concat(F.lit("藥名"), F.col("p_name"))
    ).otherwise(F.concat(F.lit("x "), F.col("p_name")))
    label = F.when(key % 4 == 0, "Quantity: ").when(key % 2 == 0, "用法 警語").otherwise(F.col("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey",
        O.strip_trailing_quantity(quantity_text()).alias("stripped"),
        O.is_quantity_only(only).alias("quantity_only"),
        O.strip_inline_header(header).alias("headless"),
        O.is_label_noise(label).alias("label_noise"),
    )


@query(
    "continuation",
    f"""
    WITH {DOC_LINES_SQL}, p AS (SELECT doc_id, line_no, trim(CASE line_no % 4 WHEN 0 THEN '(' || line WHEN 1 THEN line || ' 5 mg'
        WHEN 2 THEN line || '吸入' ELSE line END) AS l FROM lines),
    c AS (SELECT doc_id, line_no, regexp_replace(regexp_replace(l, '(?i)\\bpaff\\b', 'puff', 'g'), '\\s+', ' ', 'g') AS l FROM p)
    SELECT doc_id, line_no, starts_with(l, '(') OR {DOSAGE_SQL.format(l='l')}
        OR regexp_matches(l, '(?i)\\b(puff|puffs|bot|bottle)\\b') OR (length(l) <= 10 AND regexp_matches(l, '盒|瓶|錠|粒'))
        OR ((length(l) - length(regexp_replace(l, '{HAN}', '', 'g'))) * 1.0 / greatest(length(l), 1) >= 0.5 AND length(l) <= 25)
        OR regexp_matches(l, '噴|吸入|錠|膠囊|滴眼|注射|溶液|懸浮|粉|顆粒|口服') AS continues FROM c
    """,
)
def _continuation(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("line_no") % 4
    line = (
        F.when(kind == 0, F.concat(F.lit("("), "line")).when(kind == 1, F.concat("line", F.lit(" 5 mg")))
        .when(kind == 2, F.concat("line", F.lit("吸入"))).otherwise(F.col("line"))
    )
    return document_lines(spark, sf).select("doc_id", "line_no", O.is_continuation(line).alias("continues"))


@query(
    "non_med_strip",
    f"""
    WITH {DOC_LINES_SQL}, p AS (SELECT doc_id, line_no, line, CASE line_no % 4 WHEN 0 THEN line || '適應症：頭痛'
        WHEN 1 THEN line || '|  藥師 ' WHEN 2 THEN line || '代收健保 9' ELSE line || ' ｜' END AS l FROM lines)
    SELECT doc_id, line_no, trim(regexp_replace(CASE line_no % 4 WHEN 3 THEN l ELSE line END, '[|｜]\\s*$', '')) AS stripped,
        l <> '' AND length(trim(l)) < 60 AND NOT regexp_matches(trim(l), '^(適應症|代收)') AND
            (regexp_matches(l, '[A-Za-z]{{4,}}') OR regexp_matches(l, '(?i)\\d+\\s*(?:mg|mcg|g|ml|iu|cap|tab|inj|syr)')) AS usable FROM p
    """,
)
def _non_med_strip(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("line_no") % 4
    tail = F.when(kind == 0, "適應症：頭痛").when(kind == 1, "|  藥師 ").when(kind == 2, "代收健保 9").otherwise(" ｜")
    line = F.concat("line", tail)
    return document_lines(spark, sf).select(
        "doc_id", "line_no", O.strip_non_medication(line).alias("stripped"), O.is_usable_other_line(line).alias("usable")
    )


@query(
    "strip_dose",
    """
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 2 THEN p_name || ' 5 mg x' ELSE p_name END AS stripped FROM part
    """,
)
def _strip_dose(spark: SparkSession, sf: str) -> DataFrame:
    key, size = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    text = F.concat(
        "p_name",
        F.when(key == 0, F.concat(F.lit(" "), size, F.lit(" MG"))).when(key == 1, F.concat(F.lit("  "), size, F.lit(".5units ")))
        .otherwise(F.lit(" 5 mg x")),
    )
    return table(spark, sf, "part").select("p_partkey", I.strip_trailing_dose(text).alias("stripped"))


PHARMA_WORDS_SQL = f"""toks AS (SELECT DISTINCT unnest(string_split({sql_norm('p_name')}, ' ')) AS token FROM part),
    st AS (SELECT token, {sql_stem('token')} AS token_stem FROM toks),
    w AS (SELECT DISTINCT w AS word FROM (SELECT unnest([token, left(token, length(token) - 1), token || 'IE', 'Amoxycillin', lower(token)]) AS w FROM toks) WHERE length(w) >= 2)"""


@query(
    "pharma_stem",
    f"""
    WITH {PHARMA_WORDS_SQL}, u AS (SELECT word, upper(word) AS up, regexp_replace(upper(word), '[IE]+$', '') AS cut FROM w),
    e AS (SELECT word, token_stem, row_number() OVER (PARTITION BY word ORDER BY o, token_stem) AS rn FROM u
        JOIN (VALUES (0,'E'),(1,'NE'),(2,'INE'),(3,'IDE')) AS x(o, s) ON true JOIN st ON st.token = up || s)
    SELECT u.word, coalesce(CASE up WHEN 'AMOXYCILLIN' THEN 'AMOXICILLIN' END, e.token_stem,
        CASE WHEN {sql_stem('cut')} IN (SELECT token_stem FROM st) THEN {sql_stem('cut')} END, {sql_stem('up')}) AS pharma_stem
    FROM u LEFT JOIN e ON e.word = u.word AND e.rn = 1
    """,
)
def _pharma_stem(spark: SparkSession, sf: str) -> DataFrame:
    tokens = table(spark, sf, "part").select(F.explode(T.words(T.normalize_text("p_name"))).alias("token")).distinct()
    tokens = tokens.withColumn("token_stem", T.plural_stem("token"))
    t = F.col("token")
    forms = F.array(
        t, F.substr(t, F.lit(1), F.length(t) - 1), F.concat(t, F.lit("IE")), F.lit("Amoxycillin"), F.lower(t)
    )
    words = tokens.select(F.explode(forms).alias("w")).where(F.length("w") >= 2)
    return M.pharma_stems(words, "w", tokens)


@query(
    "token_splits",
    f"""
    WITH toks AS (SELECT DISTINCT unnest(string_split({sql_norm('p_name')}, ' ')) AS t FROM part),
    st AS (SELECT DISTINCT {sql_stem('t')} AS s FROM toks), g AS (SELECT DISTINCT {sql_norm("replace(p_name, ' ', '')")} AS w FROM part)
    SELECT w AS stem, a.s AS "left", b.s AS "right" FROM g JOIN st a ON starts_with(w, a.s) JOIN st b ON w = a.s || b.s
    WHERE length(w) >= 6 AND length(a.s) >= 3 AND length(b.s) >= 3
    """,
)
def _token_splits(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    known = part.select(F.explode(T.word_stems(T.normalize_text("p_name"))).alias("token_stem"))
    glued = part.select(T.normalize_text(F.replace("p_name", F.lit(" "), F.lit(""))).alias("w"))
    return M.token_splits(glued, "w", known)


@query(
    "case_fields",
    """
    SELECT doc_id, '每日一次' AS directions, '2024-01-0' || (doc_id % 9 + 1) AS dispensing_date, '王' AS patient_name,
        'F' AS patient_sex, '林大明' AS physician_name, '陳小美' AS pharmacist_name, '仁愛藥局' AS pharmacy_name,
        '台北 ' || doc_id AS pharmacy_address, '12顆' AS quantity, '止痛' AS first_indication FROM documents
    """,
)
def _case_fields(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("doc_id")
    text = F.concat(
        F.lit("姓名：王OO 女\n處方醫師 林大明\n藥師：\n陳小美\n仁愛藥局\n地址: 台北 "), key.cast("string"),
        F.lit("\n用法：每日一次\n用途 止痛\n總量 12 顆\n調劑日期\n2024/01/0"), (key % 9 + 1).cast("string"),
        F.lit("\nside effects: none\n"), F.col("text"),
    )
    fields = spread(table(spark, sf, "documents")).select("doc_id", case_fields(text).alias("f"))
    names = ("dispensing_date", "patient_name", "patient_sex", "physician_name", "pharmacist_name", "pharmacy_name", "pharmacy_address", "quantity")
    return fields.select(
        "doc_id",
        "f.directions",
        *[F.col(f"f.{n}").alias(n) for n in names],
        F.nullif(F.array_join("f.indications", ", "), F.lit("")).alias("first_indication"),  # all of them; the SQL sets the name
    )


def merged_items_sql(line: str) -> str:
    """Items of each document: an open name takes the next line when that continues it; repeats, in any case, go."""
    dosage, form, hint, boiler, phone, puff = (p.format(l="t") for p in (DOSAGE_SQL, FORM_SQL, HINT_SQL, BOILER_SQL, PHONE_SQL, PUFF_SQL))
    keep = f"({dosage} OR {form} OR {hint} OR (regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '\\d')))"
    squeeze = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))".format
    cleaned = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(" + squeeze("l") + r""", '^[*•·\-–—]+\s*', ''),
        '([.,;:])[.,;:]+', '\1', 'g'), '(?i)\bm\s*c\s*g\b', 'mcg', 'g'), '(?i)\bpaff\b', 'puff', 'g')"""
    return f"""WITH RECURSIVE d AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM documents),
    s AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM d),
    c AS (SELECT doc_id, line_no, {line} AS l FROM s), k AS (SELECT doc_id, line_no, {squeeze(cleaned)} AS t FROM c),
    n AS (SELECT doc_id, t, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq, (regexp_matches(t, '[A-Za-z]') OR {keep}) AND NOT {dosage} AND NOT {hint} AS opens,
        {dosage} OR {form} OR {hint} AS goes_on FROM k WHERE t <> '' AND NOT ({phone} OR {boiler} OR (length(t) < 4 AND NOT {dosage}))),
    w AS (SELECT DISTINCT doc_id, 0::BIGINT AS seq, NULL::VARCHAR AS held, []::VARCHAR[] AS done FROM n
        UNION ALL SELECT n.doc_id, n.seq,
            CASE WHEN held IS NOT NULL AND goes_on AND lower(held) <> lower(t) THEN NULL WHEN opens THEN t END,
            CASE WHEN held IS NOT NULL AND goes_on AND lower(held) <> lower(t) THEN [{squeeze("held || ' ' || t")}]
                WHEN opens THEN list_filter([held], lambda x: x IS NOT NULL) ELSE list_filter([held, t], lambda x: x IS NOT NULL) END
        FROM w JOIN n ON n.doc_id = w.doc_id AND n.seq = w.seq + 1),
    o AS (SELECT doc_id, seq, unnest(range(len(done))) AS part, unnest(done) AS item FROM w
        UNION ALL SELECT doc_id, seq + 1, 0, held FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq DESC) AS back FROM w) WHERE back = 1 AND held IS NOT NULL),
    f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(item) ORDER BY seq, part) AS copy FROM o),
    items AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY seq, part) - 1)::INTEGER AS item_no, item FROM f WHERE copy = 1)"""


RAW_ITEMS_SQL = merged_items_sql("line") + f""" SELECT doc_id, item_no, t AS display_name, least(50 + CASE WHEN {DOSAGE_SQL.format(l='t')} THEN 20 ELSE 0 END
        + CASE WHEN {FORM_SQL.format(l='t')} THEN 20 ELSE 0 END + CASE WHEN {PUFF_SQL.format(l='t')} AND NOT {DOSAGE_SQL.format(l='t')} THEN 20 ELSE 0 END
        + CASE WHEN {HINT_SQL.format(l='t')} THEN 10 ELSE 0 END, 95) / 100.0::DOUBLE AS confidence FROM (SELECT doc_id, item_no, item AS t FROM items)
    WHERE {DOSAGE_SQL.format(l='t')} OR {FORM_SQL.format(l='t')} OR {HINT_SQL.format(l='t')} OR (regexp_matches(t, '[A-Za-z]') AND regexp_matches(t, '\\d'))"""


@query("raw_line_items", RAW_ITEMS_SQL)
def _raw_line_items(spark: SparkSession, sf: str) -> DataFrame:
    """Detected items from raw text: cleaned and merged lines worth keeping, with a confidence."""
    merged = spread(table(spark, sf, "documents")).select(
        "doc_id", F.posexplode(O.merge_item_lines(text_lines("text"))).alias("item_no", "display_name")
    )
    return merged.where(O.is_worth_keeping("display_name")).withColumn("confidence", O.line_confidence("display_name"))


@query(
    "next_line_merge",
    merged_items_sql("CASE WHEN line_no % 3 = 2 THEN '20 mg ' || line ELSE line END") + " SELECT doc_id, item_no, item AS line FROM items",
)
def _next_line_merge(spark: SparkSession, sf: str) -> DataFrame:
    planted = F.transform(text_lines("text"), lambda x, i: F.when(i % 3 == 2, F.concat(F.lit("20 mg "), x)).otherwise(x))
    return spread(table(spark, sf, "documents")).select(
        "doc_id", F.posexplode(O.merge_item_lines(planted)).alias("item_no", "line")
    )


MERGE_SQL = """WITH RECURSIVE l AS (SELECT conv_id, turn, text, string_split_regex(coalesce(text, ''), '\\r?\\n') AS ls FROM conversations),
    c AS (SELECT conv_id, turn, unnest(range(len(ls)))::INTEGER AS line_no, unnest(ls) AS t FROM l),
    k AS (SELECT conv_id, turn, line_no, trim(CASE WHEN line_no % 3 = 1 THEN t || ' &' ELSE t END) AS t FROM c),
    n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS seq FROM k WHERE t <> ''),
    -- one line after the other: the text so far stays open while it ends in & or + or has an unclosed parenthesis
    w AS (SELECT conv_id, turn, seq, line_no, t AS held, 0 AS merged_no, right(t, 1) IN ('&', '+') OR length(replace(t, ')', '')) < length(replace(t, '(', '')) AS waits FROM n WHERE seq = 1
        UNION ALL SELECT conv_id, turn, seq, line_no, held, merged_no, right(held, 1) IN ('&', '+') OR length(replace(held, ')', '')) < length(replace(held, '(', ''))
        FROM (SELECT n.conv_id, n.turn, n.seq, n.line_no, CASE WHEN waits THEN held || ' ' || n.t ELSE n.t END AS held, merged_no + CASE WHEN waits THEN 0 ELSE 1 END AS merged_no
            FROM w JOIN n ON n.conv_id = w.conv_id AND n.turn = w.turn AND n.seq = w.seq + 1)),
    m AS (SELECT conv_id, turn, merged_no, min(line_no) AS lo, max(line_no) AS hi, arg_max(held, seq) AS merged_text FROM w GROUP BY ALL)
    SELECT conv_id, turn, merged_no::INTEGER AS merged_no, unnest(range(lo, hi + 1))::INTEGER AS line_no, merged_text FROM m"""


@query("merge_lines", MERGE_SQL)
def _merge_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Open-ended lines joined with the next ones, and the result spread back to the source lines."""
    planted = F.transform(text_lines("text"), lambda x, i: F.when(i % 3 == 1, F.concat(x, F.lit(" &"))).otherwise(x))
    merged = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(O.merge_open_lines(planted)).alias("merged_no", "m")
    )
    return merged.select(
        "conv_id",
        "turn",
        "merged_no",
        F.explode(F.sequence("m.first", "m.last")).alias("line_no"),
        F.col("m.text").alias("merged_text"),
    )
