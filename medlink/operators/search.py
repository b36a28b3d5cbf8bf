"""Search and browse over the catalogue, for whole tables of queries at a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlink.functions import text as T
from medlink.operators.keyed import checkpointed, chunked_lists, positions

EXACT, PREFIX, OVERLAP = 1.0, 0.8, 0.6


def relevance(query: Column, name: Column) -> Column:
    """1.0 for the same normalised text, 0.8 when the name starts with the query, else 0.6 x shared words."""
    wanted, given = F.array_distinct(F.split(query, " ")), F.split(name, " ")
    shared = F.size(F.array_intersect(wanted, given)) / F.size(wanted)
    return F.when(query == name, F.lit(EXACT)).when(name.startswith(query), F.lit(PREFIX)).otherwise(shared * OVERLAP)


def _first_by_name(keyed: DataFrame, key: str, limit: int) -> DataFrame:
    """The first ``limit`` names per key; Spark applies the limit before the shuffle as well."""
    place = F.row_number().over(Window.partitionBy(key).orderBy("_n"))
    return keyed.withColumn("_place", place).where(F.col("_place") <= limit).drop("_place")


def _word_pairs(words: Column) -> Column:
    ordered = F.array_sort(words)
    pairs = F.transform(
        ordered,
        lambda a: F.transform(F.filter(ordered, lambda b: b > a), lambda b: F.concat(a, F.lit(" "), b)),
    )
    return F.flatten(pairs)


def leading_names(queries: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(query, name, score): names enough to hold the ``limit`` best names of every query.

    For the best n items of up to k names each, ask for n x k names: the n-th item's best name has at most n x k names,
    all of the first n items, up to it.

    All names that begin with the query score alike, and so do all that share exactly one
    given word with it, so per prefix and per word only the first ``limit`` by name can
    be in a result.  Names that share two words or more are joined on word pairs.  A
    word held by a third of all names therefore never meets all queries that use it.
    """
    asked = queries.select("_q").distinct().where(F.col("_q") != "")
    given = names.select("_n").distinct().where(F.col("_n") != "")
    starts = F.transform(F.sequence(F.lit(1), F.length("_n")), lambda i: F.substr("_n", F.lit(1), i))
    by_start = asked.join(_first_by_name(given.withColumn("_q", F.explode(starts)), "_q", limit), "_q")
    query_words, name_words = F.array_distinct(F.split("_q", " ")), F.array_distinct(F.split("_n", " "))
    listed = _first_by_name(given.withColumn("_w", F.explode(name_words)), "_w", limit)
    by_word = asked.withColumn("_w", F.explode(query_words)).join(listed, "_w")
    by_pair = asked.withColumn("_w", F.explode(_word_pairs(query_words))).join(
        given.withColumn("_w", F.explode(_word_pairs(name_words))), "_w"
    )
    pairs = by_start.unionByName(by_word.drop("_w")).unionByName(by_pair.drop("_w")).distinct()
    return pairs.withColumn("score", relevance(F.col("_q"), F.col("_n")))


def ranked_search(
    queries: DataFrame,
    items: DataFrame,
    query_col: str,
    id_col: str,
    name_cols: Sequence[str],
    limit: int = 20,
) -> DataFrame:
    """Top ``limit`` items per distinct query by score, then name, then id.

    At most ``limit`` items of one name can reach a result, so each name keeps only its
    first ``limit`` ids; both limits are row_number filters, which Spark pre-applies
    before the shuffle.
    """
    asked = queries.select(F.col(query_col).alias("query"), T.normalize_text(query_col).alias("_q")).distinct()
    named = items.select(
        F.col(id_col).alias("item_id"),
        F.explode(F.array_distinct(F.array(*[T.normalize_text(c) for c in name_cols]))).alias("_n"),
    )
    in_name = F.row_number().over(Window.partitionBy("_n").orderBy("item_id"))
    few = named.where(F.col("_n") != "").distinct().withColumn("_k", in_name).where(F.col("_k") <= limit)
    # One item may carry several names: keep its best score per query.
    scored = leading_names(asked, named, limit * len(name_cols)).join(few, "_n")
    best = scored.groupBy("_q", "item_id").agg(
        F.max("score").alias("score"), F.min_by("_n", F.struct(-F.col("score"), F.col("_n"))).alias("name")
    )
    order = Window.partitionBy("_q").orderBy(F.desc("score"), F.asc("name"), F.asc("item_id"))
    top = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
    return asked.join(top, "_q").select("query", "rank", "item_id", "name", "score")


#: From this many brands on, a word's brands of a group in one bucket of numbers are kept as a bitmap of 4 KiB.
BITMAP_BRANDS = 512


def grouped_search(queries: DataFrame, items: DataFrame, query_col: str, name_col: str, group_cols: Sequence[str], brand_col: str) -> DataFrame:
    """Per query and group: number of distinct brands among the items the query finds.

    An item is found by a shared word, or by a one-word query that begins its first word.
    Items are first reduced to distinct (search key, group, brand). What a one-word query finds is counted per (key, group)
    before queries join, so a hot word meets each such query as one row a group. Words of a query of several may find the
    same brand, so brands are numbered and the brands of a hot word become bitmaps, one for each group and bucket of
    32,768 numbers: their union is exact, and the word meets its queries as a few rows whatever it finds.
    """
    asked = queries.select(F.col(query_col).alias("query"), T.normalize_text(query_col).alias("_q")).distinct()
    first = F.substring_index("_n", " ", 1)
    starts = F.transform(F.sequence(F.lit(1), F.length(first)), lambda i: F.substr(first, F.lit(1), i))
    named = items.select(T.normalize_text(name_col).alias("_n"), *group_cols, brand_col).where(F.col("_n") != "").distinct()
    words = F.array_distinct(F.split("_n", " "))
    own = named.select(F.explode(F.array_union(words, starts)).alias("_key"), *group_cols, brand_col)
    counted = own.groupBy("_key", *group_cols).agg(F.count_distinct(brand_col).alias("brand_count"))
    parts = asked.where(F.col("_q") != "").select("_q", F.array_distinct(F.split("_q", " ")).alias("_words")).distinct()
    single = parts.where(F.size("_words") == 1).select("_q", F.col("_words")[0].alias("_key")).join(counted, "_key").drop("_key")
    # words of queries of several
    numbers = checkpointed(named.select(brand_col).where(F.col(brand_col).isNotNull()).distinct())
    numbers = numbers.withColumn("_number", F.monotonically_increasing_id()).select(
        brand_col, F.bitmap_bucket_number("_number").alias("_bucket"), F.bitmap_bit_position("_number").alias("_bit")
    )
    by_word = named.select(F.explode(words).alias("_key"), *group_cols, brand_col).distinct().join(numbers, brand_col)
    place = ["_key", *group_cols, "_bucket"]
    sizes = by_word.groupBy(*place).agg(F.count(F.lit(1)).alias("_n"), F.bitmap_construct_agg("_bit").alias("_bits"))
    hot = sizes.where(F.col("_n") >= BITMAP_BRANDS).drop("_n")
    rare = by_word.join(hot.select(*[F.col(c).alias(f"h_{c}") for c in place]), _same(place, "h_"), "left_anti")
    several = parts.where(F.size("_words") > 1).select("_q", F.explode("_words").alias("_key"))
    found = ["_q", *group_cols, "_bucket"]
    bits = several.join(rare, "_key").groupBy(*found).agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    whole = several.join(hot, "_key").select(*found, "_bits").unionByName(bits).groupBy(*found).agg(F.bitmap_or_agg("_bits").alias("_bits"))
    union = whole.groupBy("_q", *group_cols).agg(F.sum(F.bitmap_count("_bits")).alias("brand_count"))
    return asked.join(union.unionByName(single), "_q").drop("_q")


def _same(columns: Sequence[str], prefix: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & F.col(c).eqNullSafe(F.col(f"{prefix}{c}"))
    return out


def prefix_tree(items: DataFrame, code_col: str, levels: Sequence[int]) -> DataFrame:
    """(parent, code, item_count) for every level of a hierarchical code."""
    pairs = [
        F.struct(
            F.substring(code_col, 1, 0 if i == 0 else levels[i - 1]).alias("parent"),
            F.substring(code_col, 1, size).alias("code"),
            F.lit(size).alias("size"),
        )
        for i, size in enumerate(levels)
    ]
    return (
        items.groupBy(code_col)
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(code_col, "_n", F.inline(F.array(*pairs)))
        .where(F.length("code") == F.col("size"))
        .groupBy("parent", "code")
        .agg(F.sum("_n").alias("item_count"))
    )


def prefix_members(items: DataFrame, code_col: str, prefix: str, group_col: str, brand_col: str) -> DataFrame:
    """Items under a code prefix, counted per group; the prefix filter reaches the scan."""
    inside = items.where(F.col(code_col).startswith(prefix))
    return inside.groupBy(group_col).agg(
        F.count_distinct(brand_col).alias("brand_count"), F.min(code_col).alias("first_code")
    )


def members_of(items: DataFrame, code_col: str, prefix: str, group_col: str, group: str, brand_col: str) -> DataFrame:
    """Distinct brands of one group under a prefix."""
    return items.where(F.col(code_col).startswith(prefix) & (F.col(group_col) == group)).select(brand_col).distinct()


def nested_lists(
    children: DataFrame, keys: Sequence[str], order: Sequence[Column], item: Column, out: str, band: Column | None = None, chunk: int = 1000
) -> DataFrame:
    """Ordered child lists per parent in bounded chunks (chunk 0 is the whole list for ordinary parents)."""
    return chunked_lists(positions(children, keys, order, "_pos", band), keys, "_pos", item, out, chunk)


def product_details(
    products: DataFrame, product_ingredients: DataFrame, concepts: DataFrame, links: DataFrame, permits: DataFrame, atc: DataFrame
) -> dict[str, DataFrame]:
    """The enriched product: flat columns with ATC, and the nested lists as tables (product_code, chunk_no, list)."""
    flat = products.join(atc, "atc_code", "left")
    named = product_ingredients.join(concepts.select("ingredient_id", "canonical_name"), "ingredient_id")
    ingredients = nested_lists(
        named,
        ["product_code"],
        [F.col("canonical_name"), F.col("source")],
        F.struct("ingredient_id", "canonical_name", "role", "strength_value", "strength_unit", "source"),
        "ingredients",
    )
    linked = links.join(permits, "permit_no")
    permit_lists = nested_lists(
        linked,
        ["product_code"],
        [F.col("permit_no")],
        F.struct("permit_no", "product_name", "dosage_form", "ingredient_text", "is_cancelled"),
        "permits",
    )
    return {"products": flat, "ingredients": ingredients, "permits": permit_lists}


def active_ingredients(product_ingredients: DataFrame, role: str = "active") -> DataFrame:
    """Ingredients that a product's page shows: those with the active role, others and null roles are left out."""
    return product_ingredients.where(F.col("role") == role)


def enriched_products(
    products: DataFrame,
    product_ingredients: DataFrame,
    concepts: DataFrame,
    links: DataFrame,
    permits: DataFrame,
    atc: DataFrame,
    variants: DataFrame,
    chunk: int = 1000,
) -> DataFrame:
    """Every product with its classification and its lists: ingredients, ingredient_names, permits and variants.

    ingredients are ordered by name and source, ingredient_names are distinct and ordered, permits go by number, variants
    by language, type and text. A list of more than ``chunk`` items goes on in further rows of its product, with the next
    chunk_no; a product without any list has one row, of chunk 0. links(product_code, permit_no, link_source).
    """
    named = product_ingredients.join(concepts.select("ingredient_id", "canonical_name"), "ingredient_id")
    key = ["product_code"]
    ingredient = F.struct("ingredient_id", "canonical_name", "role", "strength_value", "strength_unit", "source")
    permit = F.struct("permit_no", "product_name", "dosage_form", "ingredient_text", "is_cancelled", "link_source")
    of_products = variants.where(F.col("target_type") == "product").withColumnRenamed("target_id", "product_code")
    variant = F.struct(F.col("variant_text").alias("text"), "language", F.col("variant_type").alias("type"))
    lists = (
        nested_lists(named, key, [F.col("canonical_name"), F.col("source"), F.col("ingredient_id")], ingredient, "ingredients", chunk=chunk),
        nested_lists(named.select("product_code", "canonical_name").distinct(), key, [F.col("canonical_name")], F.col("canonical_name"), "ingredient_names", chunk=chunk),
        nested_lists(links.join(permits, "permit_no"), key, [F.col("permit_no"), F.col("link_source")], permit, "permits", chunk=chunk),
        nested_lists(of_products, key, [F.col("language"), F.col("variant_type"), F.col("variant_text")], variant, "variants", chunk=chunk),
    )
    chunks = None
    for df in lists:
        chunks = df if chunks is None else chunks.join(df, ["product_code", "chunk_no"], "full")
    flat = products.join(atc, "atc_code", "left")
    return flat.join(chunks, "product_code", "left").withColumn("chunk_no", F.coalesce("chunk_no", F.lit(0)))
