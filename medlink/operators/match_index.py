"""What line matching asks of a dictionary, as tables that are built once and stored under a release.

* Exact keys: one row per (method, key), whatever number of products share it.
* Cover postings: a name is reached through the pair of its two rarest words, a one-word name through that word. So a name
  whose rarest word is common is still found through few rows. Each first word lists its second words, or counts them
  where they are many.
* Overlap postings: stem sets of products by pairs of words. Two sets that share m of a line's n known words share two of
  the line's n - m + 2 rarest ones.
* Han names, one row a name. Of names longer than WHOLE characters also their grams: every run of up to GRAM characters,
  with the number of its products and the longest of its names.

Every table may grow with the dictionary while its file stays small (few words, many rows), and Spark sizes a table by its
file; so all carry a merge hint and none is broadcast.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V
from medlink.functions import text as T
from medlink.operators.curate import token_index, with_name_keys
from medlink.operators.keyed import checkpointed
from medlink.sources.writers import current_release, has_release, publish_release, read_release, release_tables

#: A stem in fewer stem sets than this identifies products by itself.
RARE_STEM_SETS = 16
#: Second words of a first word are listed up to this number; beyond it a line's own words are tried.
LISTED_PARTNERS = 64
#: Longest gram of the Han index.
GRAM = 4
#: Han runs with up to this number of characters are looked for whole, among the runs of the names.
WHOLE = 32
#: So few tables are built from the dictionary as it is; for more it is written once.
FEW_TABLES = 4
#: Stands for the second word of a name of one word.
NO_WORD = ""


@dataclass(frozen=True)
class Dictionary:
    """The curated tables a line is matched against.

    products(product_code, name_en, name_zh, effective_start), concepts(ingredient_id,
    canonical_name, canonical_name_normalized), product_ingredients(product_code,
    ingredient_id), variants(target_type, target_id, variant_text, normalized_text).
    """

    products: DataFrame
    concepts: DataFrame
    product_ingredients: DataFrame
    variants: DataFrame

    def named_products(self) -> DataFrame:
        having = self.product_ingredients.select("product_code").distinct().withColumn("_has", F.lit(True)).hint("merge")
        return self.products.join(having, "product_code", "left").select(
            F.col("product_code").alias("product_id"),
            F.coalesce("name_en", "name_zh").alias("product_name"),
            F.coalesce("_has", F.lit(False)).alias("has_ids"),
            "effective_start",
            "name_en",
            "name_zh",
        )

    def materialised(self) -> Dictionary:
        """The same tables written once, for plans that read them many times.

        Tables read from a release are files already and need no copy.
        """
        return Dictionary(
            *[checkpointed(df) for df in (self.products, self.concepts, self.product_ingredients, self.variants)]
        )

    def ingredient_tokens(self) -> DataFrame:
        return token_index(self.concepts, ["ingredient_id"], "canonical_name_normalized")


@dataclass(frozen=True)
class MatchIndex:
    """Tables of the index; their columns are in the functions that build them.  Of a stored index some may be absent."""

    exact_keys: DataFrame | None = None
    ingredient_sets: DataFrame | None = None
    ingredient_partners: DataFrame | None = None
    product_sets: DataFrame | None = None
    product_partners: DataFrame | None = None
    overlap_pairs: DataFrame | None = None
    overlap_single: DataFrame | None = None
    overlap_words: DataFrame | None = None
    tokens: DataFrame | None = None
    clean_stems: DataFrame | None = None
    han_names: DataFrame | None = None
    han_long: DataFrame | None = None
    han_grams: DataFrame | None = None
    owned: DataFrame | None = None
    concept_names: DataFrame | None = None


TABLES = tuple(f.name for f in fields(MatchIndex))


def newest_first(*ties: str) -> Column:
    start = F.col("effective_start")
    return F.struct(start.isNull(), -F.unix_date(start), *[F.col(t) for t in ties])


# --- exact keys -----------------------------------------------------------------


def _best_product(keyed: DataFrame, method: str) -> DataFrame:
    best = F.min_by(F.struct("product_id", "product_name", "has_ids"), newest_first("product_id")).alias("_best")
    return keyed.groupBy("key").agg(best).select(F.lit(method).alias("method"), "key", "_best.*", F.lit(None).cast("string").alias("ingredient_id"))


def _single_ingredient(keyed: DataFrame, method: str) -> DataFrame:
    """Keys with exactly one ingredient; min = max is 'one distinct id' and combines map-side."""
    none = F.lit(None).cast("string")
    return (
        keyed.groupBy("key")
        .agg(F.min("ingredient_id").alias("_lo"), F.max("ingredient_id").alias("_hi"))
        .where(F.col("_lo") == F.col("_hi"))
        .select(
            F.lit(method).alias("method"), "key", none.alias("product_id"), none.alias("product_name"),
            F.lit(False).alias("has_ids"), F.col("_lo").alias("ingredient_id"),
        )
    )


def exact_key_table(d: Dictionary) -> DataFrame:
    """(method, key) -> the one answer that key gives; keys that must fall through are absent."""
    products, variants = d.named_products(), d.variants
    by_variant = (
        variants.where(F.col("target_type") == "product")
        .select(F.col("normalized_text").alias("key"), F.col("target_id").alias("product_id"))
        .join(products.hint("merge"), "product_id")
    )
    by_name_key = with_name_keys(products).withColumn(
        "key", F.explode(F.array_distinct(F.array("ocr_key_en", "ocr_key_zh")))
    ).where(F.length("key") >= 4)
    canonical = d.concepts.select(F.col("canonical_name_normalized").alias("key"), "ingredient_id")
    alias = variants.where(F.col("target_type") == "ingredient").select(
        F.col("normalized_text").alias("key"), F.col("target_id").alias("ingredient_id")
    )
    alias = alias.join(d.concepts.select("ingredient_id").hint("merge"), "ingredient_id", "left_semi")
    paren = alias.unionByName(canonical).where(F.length("key") >= 3)
    return (
        _best_product(by_variant, "product_exact")
        .unionByName(_best_product(by_name_key, "ocr_product"))
        .unionByName(_single_ingredient(canonical, "canonical_exact"))
        .unionByName(_single_ingredient(alias, "alias_exact"))
        .unionByName(_single_ingredient(paren, "paren_alias_exact"))
    )


# --- names by their words ---------------------------------------------------------


def _ranked(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets with _ranked: their stems from the rarest on, as structs of df and stem; stems: stem, df, largest).

    sets have distinct arrays ``stems``. largest: the most stems of a set that holds the stem.
    """
    keyed = sets.withColumn("_id", F.array_join("stems", " "))
    exploded = keyed.select("_id", F.size("stems").alias("_n"), F.explode("stems").alias("stem"))
    words = exploded.groupBy("stem").agg(F.count(F.lit(1)).alias("df"), F.max("_n").alias("largest"))
    order = (
        exploded.join(words.hint("merge"), "stem")
        .groupBy("_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "stem"))).alias("_ranked"))
    )
    return keyed.join(order.hint("merge"), "_id").drop("_id"), words


def cover_index(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(postings: key_a, key_b and the columns of sets; partners: key_a, and its key_b as a list if they are few).

    key_a and key_b are the two rarest stems of a set, rarest first.
    """
    ranked, _ = _ranked(sets)
    word = lambda i: F.get(F.col("_ranked"), F.lit(i))["stem"]
    postings = ranked.withColumns({"key_a": word(0), "key_b": F.coalesce(word(1), F.lit(NO_WORD))}).drop("_ranked")
    pairs = postings.select("key_a", "key_b").distinct()
    counts = pairs.groupBy("key_a").agg(F.count(F.lit(1)).alias("n_partners"))
    few = pairs.join(counts.where(F.col("n_partners") <= LISTED_PARTNERS).hint("merge"), "key_a")
    listed = few.groupBy("key_a").agg(F.array_sort(F.collect_list("key_b")).alias("partners"))
    many = counts.where(F.col("n_partners") > LISTED_PARTNERS).select("key_a", F.lit(None).cast("array<string>").alias("partners"))
    return postings, listed.unionByName(many)


def ingredient_stem_sets(d: Dictionary) -> DataFrame:
    """Distinct stem sets of canonical names: the least and largest token signature, and the first name of each."""
    tokens = F.array_distinct(T.words("canonical_name_normalized"))
    names = d.concepts.select(
        "ingredient_id",
        "canonical_name",
        F.array_sort(F.array_distinct(F.transform(tokens, T.plural_stem))).alias("stems"),
        F.array_join(F.array_sort(tokens), "|").alias("signature"),
    )
    first = F.min(F.struct(F.length("canonical_name").alias("length"), "canonical_name", "ingredient_id")).alias("first")
    return (
        names.where(F.size("stems") > 0)
        .groupBy("stems")
        .agg(F.min("signature").alias("low"), F.max("signature").alias("high"), first)
    )


def product_stem_sets(d: Dictionary) -> DataFrame:
    """Distinct stem sets of products with the smallest product of each set."""
    stems = F.array_sort(
        F.array_union(T.word_stems(T.normalize_text("name_zh")), T.word_stems(T.normalize_text("name_en")))
    )
    return (
        d.named_products()
        .withColumn("stems", stems)
        .where(F.size("stems") > 0)
        .groupBy("stems")
        .agg(F.min(F.struct("product_id", "product_name", "has_ids")).alias("_best"))
        .select("stems", "_best.*")
    )


def variant_stem_sets(d: Dictionary) -> DataFrame:
    """Distinct stem sets of single product names: smallest and largest product, smallest name."""
    sets = (
        d.named_products()
        .select(
            "product_id",
            "product_name",
            F.explode(F.array(T.normalize_text("name_zh"), T.normalize_text("name_en"))).alias("_name"),
        )
        .withColumn("stems", F.array_sort(T.word_stems("_name")))
        .where(F.size("stems") > 0)
    )
    return sets.groupBy("stems").agg(
        F.min("product_id").alias("product_id"), F.max("product_id").alias("last_product_id"), F.min("product_name").alias("product_name")
    )


def _pairs(ranked: Column) -> Column:
    """All pairs of an array of ranked stems: structs of a, b and a's df, a before b."""
    return F.flatten(
        F.transform(
            ranked,
            lambda x, i: F.transform(
                F.slice(ranked, i + 2, F.size(ranked)), lambda y: F.struct(x["stem"].alias("stem_a"), y["stem"].alias("stem_b"), x["df"].alias("df_a"))
            ),
        )
    )


def overlap_index(d: Dictionary) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs: stem_a, stem_b, stems, product; single: stem and its smallest product; words: stem, df, largest).

    Names differ mostly in a few rare words, so pairs are kept in two tiers.  A pair that begins with a rare stem lists
    whole stem sets, fewer than RARE_STEM_SETS of them.  A pair of common stems lists only the distinct *common parts* of
    stem sets, each with its smallest product.  This is exact: a product none of whose rare stems is in the line shares
    only common stems with it; one with a rare stem in the line is reached through its rarest shared stem with its full
    count, which outranks its common part.
    """
    sets = product_stem_sets(d)
    ranked, words = _ranked(sets)
    product = ["product_id", "product_name", "has_ids"]
    rare = (
        ranked.select("stems", *product, F.explode(_pairs(F.col("_ranked"))).alias("p"))
        .where(F.col("p.df_a") < RARE_STEM_SETS)
        .select("p.stem_a", "p.stem_b", "stems", *product)
    )
    parts = (
        ranked.withColumn("_common", F.filter("_ranked", lambda x: x["df"] >= RARE_STEM_SETS))
        .where(F.size("_common") > 1)
        .groupBy("_common")
        .agg(F.min(F.struct(*product)).alias("_best"))
    )
    common = parts.select(
        F.transform("_common", lambda x: x["stem"]).alias("stems"), "_best.*", F.explode(_pairs(F.col("_common"))).alias("p")
    ).select("p.stem_a", "p.stem_b", "stems", *product)
    single = (
        sets.select(F.explode("stems").alias("stem"), *product)
        .groupBy("stem")
        .agg(F.min(F.struct(*product)).alias("_best"))
        .select("stem", "_best.*")
    )
    return rare.unionByName(common), single, words


def clean_stem_table(tokens: DataFrame, limit: int) -> DataFrame:
    """(token_stem, ingredient_id): a stem of more than ``limit`` ingredients is one row without an id."""
    owners = tokens.select("token_stem", "ingredient_id").distinct()
    wide = owners.groupBy("token_stem").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("token_stem")
    return owners.join(wide.hint("merge"), "token_stem", "left_anti").unionByName(wide.withColumn("ingredient_id", F.lit(None).cast("string")))


# --- Han names ----------------------------------------------------------------------


def grams(text: Column, size: int) -> Column:
    last = F.length(text) - size + 1
    return F.when(
        last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    ).otherwise(F.array().cast("array<string>"))


def han_index(d: Dictionary) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names: product_id, product_name, has_ids, effective_start; of long ones by gram; grams: gram, products, names, longest)."""
    names = (
        d.variants.where((F.col("target_type") == "product") & T.has_cjk("variant_text"))
        .select(F.col("target_id").alias("product_id"), F.col("variant_text").alias("product_name"))
        .distinct()
        .join(d.named_products().select("product_id", "has_ids", "effective_start").hint("merge"), "product_id")
    )
    name = F.col("product_name")
    sizes = [grams(name, n) for n in range(1, GRAM + 1)]
    indexed = names.where(F.length(name) > WHOLE).withColumn("gram", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), *sizes))))
    counts = indexed.groupBy("gram").agg(
        F.count_distinct("product_id").alias("n_products"), F.count(F.lit(1)).alias("n_names"), F.max(F.length("product_name")).alias("longest")
    )
    return names, indexed, counts


# --- the whole index -------------------------------------------------------------------


def build_index(d: Dictionary) -> MatchIndex:
    """The index as plans over the dictionary; nothing is computed yet."""
    tokens = d.ingredient_tokens()
    built = (
        exact_key_table(d),
        *cover_index(ingredient_stem_sets(d)),
        *cover_index(variant_stem_sets(d)),
        *overlap_index(d),
        tokens.select("token", "token_stem").distinct(),
        clean_stem_table(tokens, V.CLEAN_MAX_INGREDIENTS),
        *han_index(d),
        d.product_ingredients.select("product_code", "ingredient_id").distinct(),
        d.concepts.select("ingredient_id", "canonical_name"),
    )
    return MatchIndex(*[df.hint("merge") for df in built])


def store_index(d: Dictionary, root: str, release: str, tables: Sequence[str] = TABLES) -> MatchIndex:
    """Write tables of the index under a new release and read them back; readers follow the release pointer."""
    spark = d.products.sparkSession
    index = build_index(d.materialised() if len(tables) > FEW_TABLES else d)
    publish_release(spark, {name: getattr(index, name) for name in tables}, root, release)
    return read_index(spark, root)


def add_tables(d: Dictionary, root: str, release: str, tables: Sequence[str]) -> MatchIndex:
    """Write those ``tables`` that the release lacks; the others stay."""
    spark = d.products.sparkSession
    stored = release_tables(spark, root) if has_release(spark, root) else {}
    missing = [name for name in tables if name not in stored]
    if missing:
        index = build_index(d.materialised() if len(missing) > FEW_TABLES else d)
        publish_release(spark, {name: getattr(index, name) for name in missing}, root, release, stored)
    return read_index(spark, root)


def read_index(spark: SparkSession, root: str) -> MatchIndex:
    """The index of the current release; tables that it lacks are None."""
    stored = release_tables(spark, root)
    return MatchIndex(**{name: read_release(spark, root, name).hint("merge") for name in TABLES if name in stored})


def index_release(spark: SparkSession, root: str) -> str:
    return current_release(spark, root)


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which all executors see; a local session without the setting gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not is_local(spark):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def is_local(spark: SparkSession) -> bool:
    """Driver and tasks in one process."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def as_index(d: Dictionary | MatchIndex) -> MatchIndex:
    return d if isinstance(d, MatchIndex) else build_index(d)
