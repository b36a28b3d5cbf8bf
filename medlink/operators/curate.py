"""Curation: products, permits, links, concepts, variants, token indexes and review items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.functions import ingredients as I
from medlink.functions import text as T
from medlink.functions.ocr_text import name_key
from medlink.operators.keyed import anti_insert, distinct_values, keep_first, latest_version, overlay, pick


def current_products(items: DataFrame, built_at: Column) -> DataFrame:
    """Newest version of every product, projected to the curated columns."""
    known = items.columns
    ties = [c for c in ("name_en", "name_zh", "ingredient_text", "dose_form") if c in known]
    newest = latest_version(items, "product_code", "effective_start", "effective_end", ties)
    return newest.withColumns({"is_combo": T.is_combo("combo_flag"), "updated_at": built_at})


def permit_lookup(all_permits: DataFrame, active: DataFrame) -> DataFrame:
    """One row per permit number; an active permit wins over the full list."""
    one = lambda df: pick(
        df.where(F.trim("permit_no") != ""),
        ["permit_no"],
        [F.struct(*[F.col(c) for c in sorted(df.columns) if c != "permit_no"])],
        last=True,
    )
    return overlay(one(all_permits), one(active), "permit_no")


def curated_permits(permits: DataFrame, built_at: Column) -> DataFrame:
    some = lambda name: F.nullif(F.col(name), F.lit(""))
    return permits.select(
        "permit_no",
        T.is_cancelled("cancel_status").alias("is_cancelled"),
        "cancel_date",
        "expiry_date",
        "issue_date",
        "controlled_substance_level",
        F.coalesce(some("product_name_zh"), F.col("product_name_en")).alias("product_name"),
        "dosage_form",
        "packaging",
        "ingredient_text",
        "applicant_name",
        "applicant_address",
        "applicant_tax_id",
        "manufacturer_name",
        F.coalesce(some("manufacturer_company_address"), F.col("manufacturer_site_address")).alias(
            "manufacturer_address"
        ),
        "manufacturer_country",
        built_at.alias("updated_at"),
    )


def latest_atc(atc: DataFrame) -> DataFrame:
    order = [F.col("snapshot_date"), *[F.col(c) for c in ("atc_name", "uom", "adm_r", "note") if c in atc.columns]]
    return pick(atc.where(F.trim("atc_code") != ""), ["atc_code"], order, last=True)


def _digits_tail(c: Column) -> Column:
    digits = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(digits) >= 6, F.right(digits, F.lit(6)))


def link_permits(products: DataFrame, permits: DataFrame) -> DataFrame:
    """(product_code, permit_no): exact token, else the best permit with the same last six digits.

    Among several candidates: the only one whose name matches, else the first with the
    same form, else the first; permits are ordered by number.  The candidates of a
    digit tail are first summarised per (tail, name) and (tail, form), so a tail shared
    by a great many permits never meets a great many products row by row.
    """
    tokens = products.withColumn("_token", T.permit_token("permit_link")).where(F.col("_token").isNotNull())
    named = permits.select(
        "permit_no",
        F.array_distinct(
            F.array(T.normalize_text("product_name_zh"), T.normalize_text("product_name_en"))
        ).alias("_names"),
        T.normalize_text("dosage_form").alias("_form"),
        _digits_tail(F.col("permit_no")).alias("_tail"),
    )
    direct = tokens.join(named.select(F.col("permit_no").alias("_token")), "_token", "left_semi").select(
        "product_code", F.col("_token").alias("permit_no")
    )
    rest = (
        tokens.join(direct.select("product_code"), "product_code", "left_anti")
        .select(
            "product_code",
            _digits_tail(F.col("_token")).alias("_tail"),
            F.filter(
                F.array_distinct(F.array(T.normalize_text("name_zh"), T.normalize_text("name_en"))), lambda n: n != ""
            ).alias("_names"),
            T.normalize_text("dose_form").alias("_form"),
        )
        .where(F.col("_tail").isNotNull())
    )
    tails = named.where(F.col("_tail").isNotNull())
    by_tail = tails.groupBy("_tail").agg(F.min("permit_no").alias("_any"), F.count(F.lit(1)).alias("_size"))
    by_form = tails.groupBy("_tail", "_form").agg(F.min("permit_no").alias("_same_form"))
    # A permit counts once per product even if both its names match, so per (tail, name) keep
    # the smallest and largest permit number: more than one permit iff they differ overall.
    by_name = (
        tails.select("_tail", "permit_no", F.explode("_names").alias("_name"))
        .where(F.col("_name") != "")
        .groupBy("_tail", "_name")
        .agg(F.min("permit_no").alias("_lo"), F.max("permit_no").alias("_hi"))
    )
    named_hit = (
        rest.select("product_code", "_tail", F.explode("_names").alias("_name"))
        .join(by_name, ["_tail", "_name"])
        .groupBy("product_code")
        .agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
        .select("product_code", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("_only_named"))
    )
    fallback = (
        rest.drop("_names")
        .join(by_tail, "_tail")
        .join(by_form, ["_tail", "_form"], "left")
        .join(named_hit, "product_code", "left")
        .select(
            "product_code",
            F.when(F.col("_size") == 1, F.col("_any"))
            .otherwise(F.coalesce("_only_named", "_same_form", "_any"))
            .alias("permit_no"),
        )
    )
    return direct.unionByName(fallback)


def ingredient_mentions(texts: DataFrame, source: str, kind: str = "item") -> DataFrame:
    """(product_code, mention, source) from (product_code, ingredient_text)."""
    split = T.split_item_ingredients if kind == "item" else T.split_permit_ingredients
    return texts.select(
        "product_code",
        F.explode(split("ingredient_text")).alias("mention"),
        F.lit(source).alias("source"),
    )


def build_concepts(mentions: DataFrame) -> DataFrame:
    """One concept per normalised name; the smallest spelling is the canonical one.  A spelling is normalised once, not once a product."""
    name = T.canonical_name("mention")
    return (
        distinct_values(mentions, "mention")
        .select(T.normalize_text(name).alias("canonical_name_normalized"), name.alias("canonical_name"))
        .groupBy("canonical_name_normalized")
        .agg(F.min("canonical_name").alias("canonical_name"))
        .withColumn("ingredient_id", T.name_uuid("canonical_name_normalized"))
    )


def mention_id(mention: Column | str) -> Column:
    return T.name_uuid(T.normalize_text(T.canonical_name(mention)))


def product_ingredients(mentions: DataFrame) -> DataFrame:
    """Distinct (product_code, ingredient_id, source) with the constant role columns."""
    return (
        mentions.select("product_code", mention_id("mention").alias("ingredient_id"), "source")
        .distinct()
        .select(
            "product_code",
            "ingredient_id",
            F.lit("active").alias("role"),
            F.lit(None).cast("decimal(18,6)").alias("strength_value"),
            F.lit(None).cast("string").alias("strength_unit"),
            "source",
        )
    )


def name_variants(products: DataFrame, mentions: DataFrame) -> DataFrame:
    """Product names and ingredient spellings under one key; duplicates keep the first spelling."""
    names = F.array(
        F.struct(F.lit("zh").alias("language"), F.lit("product_name_zh").alias("variant_type"), F.col("name_zh").alias("variant_text")),
        F.struct(F.lit("en").alias("language"), F.lit("product_name_en").alias("variant_type"), F.col("name_en").alias("variant_text")),
    )
    of_products = products.select(
        F.lit("product").alias("target_type"),
        F.col("product_code").alias("target_id"),
        F.inline(F.filter(names, lambda n: n["variant_text"] != "")),
        F.lit("item").alias("source"),
    )
    of_ingredients = mentions.select(
        F.lit("ingredient").alias("target_type"),
        mention_id("mention").alias("target_id"),
        T.language_tag("mention").alias("language"),
        F.lit("ingredient_alias").alias("variant_type"),
        F.col("mention").alias("variant_text"),
        "source",
    )
    keys = ["target_type", "target_id", "normalized_text", "source"]
    both = of_products.unionByName(of_ingredients).withColumn("normalized_text", T.normalize_text("variant_text"))
    kept = keep_first(both, keys, ["variant_type", "variant_text", "language"])
    return kept.withColumn("variant_id", T.name_uuid(F.concat_ws("|", *keys)))


def token_index(names: DataFrame, id_cols: list[str], text_col: str) -> DataFrame:
    """(ids, token, token_stem): distinct words of at least two characters."""
    return names.select(
        *id_cols, F.explode(F.array_distinct(T.words(text_col))).alias("token")
    ).withColumn("token_stem", T.plural_stem("token"))


def variant_token_index(variants: DataFrame) -> DataFrame:
    of_products = variants.where(F.col("target_type") == "product")
    return token_index(of_products, ["variant_id", "target_id"], "normalized_text").withColumnRenamed(
        "target_id", "product_code"
    )


def token_counts(variant_tokens: DataFrame) -> DataFrame:
    """Distinct stems per product (two-level distinct, so map-side combined)."""
    return variant_tokens.groupBy("product_code").agg(F.count_distinct("token_stem").alias("token_count"))


def with_name_keys(products: DataFrame) -> DataFrame:
    """Names prepared once for line matching."""
    return products.withColumns(
        {
            "ocr_key_en": name_key(F.coalesce("name_en", F.lit(""))),
            "ocr_key_zh": name_key(F.coalesce("name_zh", F.lit(""))),
        }
    )


def map_aliases(tokens: DataFrame, token_col: str, aliases: DataFrame) -> DataFrame:
    """Alias mapping against a table (alias, canonical): exact name or longest leading words.

    Every leading word run of each distinct token is an equi-join key, so any alias
    count works; the longest hit per token is a combined aggregate.
    """
    distinct = tokens.select(F.col(token_col).alias("_token")).distinct()
    parts = F.split("_token", " ")
    leads = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), " "))
    best = (
        distinct.select("_token", F.explode(leads).alias("alias"))
        .join(aliases.select("alias", "canonical"), "alias")
        .groupBy("_token")
        .agg(F.max_by(F.struct("alias", "canonical"), F.struct(F.length("alias"), F.col("canonical"))).alias("_hit"))
    )
    mapped = F.when(
        F.col("_hit").isNotNull(),
        F.concat("_hit.canonical", F.substr(F.col("_token"), F.length("_hit.alias") + 1)),
    ).otherwise(F.col("_token"))
    resolved = distinct.join(best, "_token", "left").select(
        F.col("_token").alias(token_col), mapped.alias("mapped"), F.col("_hit.alias").alias("alias_used")
    )
    return tokens.join(resolved, token_col, "left")


def alias_usage(tokens: DataFrame, token_col: str, lookup: dict[str, str] | None = None) -> DataFrame:
    """How often each canonical name replaced another spelling."""
    names = I.alias_lookup() if lookup is None else lookup
    used = tokens.where(I.apply_alias(token_col, names) != F.col(token_col))
    return used.groupBy(I.alias_target(token_col, names).alias("canonical")).agg(F.count(F.lit(1)).alias("uses"))


def _token_set(texts: Column, lookup: dict[str, str] | None) -> Column:
    return F.array_distinct(F.flatten(F.transform(texts, lambda x: I.compare_tokens(x, lookup))))


def overlap_measures(left: Column, right: Column) -> dict[str, Column]:
    both, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return {
        "both": both,
        "either": either,
        "right_only": F.size(F.array_except(right, left)),
        "left_only": F.size(F.array_except(left, right)),
        "ratio": both / F.nullif(either, F.lit(0)),
    }


def set_overlap(left: DataFrame, right: DataFrame, key: str, item: str) -> DataFrame:
    """(key, both, either, left_only, right_only, ratio) of two item sets per key.

    Works on (key, item) rows and never gathers a set, so a key may hold any number of items.
    """
    sides = left.select(key, item, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(key, item, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    merged = sides.groupBy(key, item).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    both = F.sum(F.col("_l") * F.col("_r"))
    return merged.groupBy(key).agg(
        both.alias("both"),
        F.count(F.lit(1)).alias("either"),
        F.sum(F.col("_l") * (1 - F.col("_r"))).alias("left_only"),
        F.sum(F.col("_r") * (1 - F.col("_l"))).alias("right_only"),
        (both / F.count(F.lit(1))).alias("ratio"),
    )


def mismatch_items(pairs: DataFrame, threshold: float = 0.6, lookup: dict[str, str] | None = None) -> DataFrame:
    """Review rows from (product_code, permit_no, item_text, permit_text).

    Quiet when a side is empty, the sets are equal, the permit adds nothing, or the
    overlap ratio reaches the threshold.
    """
    item_parts = T.split_item_ingredients(I.strip_strength(F.coalesce("item_text", F.lit(""))))
    permit_parts = T.split_permit_ingredients("permit_text")
    side = lambda parts: T.let(
        parts, lambda p: F.struct(p.alias("parts"), _token_set(p, lookup).alias("keys"))
    )

    def compare(s: Column) -> Column:
        a, b = s["a"]["keys"], s["b"]["keys"]
        m = overlap_measures(a, b)
        differs = (F.size(a) > 0) & (F.size(b) > 0) & (m["right_only"] > 0)
        return F.struct(
            s["a"]["parts"].alias("item"),
            s["b"]["parts"].alias("permit"),
            (differs & (m["ratio"] < F.lit(float(threshold)))).alias("open"),
            m["ratio"].alias("ratio"),
        )

    both = F.struct(side(item_parts).alias("a"), side(permit_parts).alias("b"))
    sides = pairs.select(
        "product_code", "permit_no", "item_text", F.inline(F.array(T.let(both, compare))).alias("_item", "_permit", "_open", "_ratio")
    )
    open_rows = F.col("_open")
    permit_text = F.array_join("_permit", " ;; ")
    return sides.where(open_rows).select(
        T.name_uuid(F.concat_ws("|", F.lit("mismatch"), "product_code", "permit_no", "item_text", permit_text)).alias(
            "review_id"
        ),
        F.lit("tfda_mismatch").alias("source"),
        "product_code",
        "permit_no",
        F.col("item_text").alias("input_text"),
        permit_text.alias("ocr_text"),
        F.array_sort(F.array_distinct(F.transform(F.concat("_item", "_permit"), mention_id))).alias(
            "candidate_ingredient_ids"
        ),
        F.col("_ratio").alias("confidence"),
        F.lit("pending").alias("status"),
        F.concat(
            F.lit("NHI ingredients: "), F.col("item_text"), F.lit("; TFDA ingredients: "), permit_text
        ).alias("review_notes"),
    )


def carry_over_reviews(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old queue without its pending mismatches, plus new rows it does not already hold."""
    pending = (F.col("source") == "tfda_mismatch") & (F.col("status") == "pending")
    kept = old.where(~F.coalesce(pending, F.lit(False)))
    signature = ["source", "product_code", "permit_no", "input_text", "ocr_text"]
    once = pick(new, signature, [F.col("review_id")])
    return kept.unionByName(anti_insert(kept, once, signature), allowMissingColumns=True)
