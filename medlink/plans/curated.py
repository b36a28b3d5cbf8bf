"""The curated rebuild and its quality report, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlink.operators import curate as C
from medlink.operators import quality as Q
from medlink.sources.writers import publish_release


def curated_build(
    items: DataFrame,
    permits_all: DataFrame,
    permits_active: DataFrame,
    atc: DataFrame,
    built_at: str,
    threshold: float = 0.6,
    old_reviews: DataFrame | None = None,
    clean_before_split: bool = False,
) -> dict[str, DataFrame]:
    """Nine curated tables from four raw ones."""
    stamp = F.to_timestamp(F.lit(built_at))
    products = C.current_products(items, stamp)
    lookup = C.permit_lookup(permits_all, permits_active)
    links = C.link_permits(products, lookup)
    permit_texts = links.join(lookup.select("permit_no", "ingredient_text"), "permit_no")
    item_texts = products
    if clean_before_split:
        from medlink.functions.ingredients import strip_strength

        item_texts = products.withColumn("ingredient_text", strip_strength("ingredient_text"))
    mentions = C.ingredient_mentions(item_texts, "nhi").unionByName(
        C.ingredient_mentions(permit_texts, "tfda", kind="permit")
    )
    pairs = permit_texts.select("product_code", "permit_no", F.col("ingredient_text").alias("permit_text")).join(
        products.select("product_code", F.col("ingredient_text").alias("item_text")), "product_code"
    )
    reviews = C.mismatch_items(pairs, threshold).withColumn("created_at", stamp)
    # Ingredients named only in review candidates become concepts as well.
    concepts = C.build_concepts(mentions.select("mention").unionByName(_review_mentions(reviews, pairs)))
    return {
        "products": products,
        "permits": C.curated_permits(lookup, stamp),
        "links": links.select("product_code", "permit_no", F.lit("nhi_tfda_link").alias("link_source")),
        "concepts": concepts,
        "product_ingredients": C.product_ingredients(mentions),
        "name_variants": C.name_variants(products, mentions),
        "ingredient_tokens": C.token_index(concepts, ["ingredient_id"], "canonical_name_normalized"),
        "atc": C.latest_atc(atc),
        "reviews": reviews if old_reviews is None else C.carry_over_reviews(old_reviews, reviews),
    }


def _review_mentions(reviews: DataFrame, pairs: DataFrame) -> DataFrame:
    from medlink.functions import ingredients as I
    from medlink.functions import text as T

    open_pairs = pairs.join(reviews.select("product_code", "permit_no"), ["product_code", "permit_no"], "left_semi")
    parts = T.split_item_ingredients(I.strip_strength("item_text"))
    return open_pairs.select(F.explode(parts).alias("mention"))


def rebuild(spark: SparkSession, raw: dict[str, DataFrame], root: str, release: str, built_at: str, **options) -> None:
    """Build and publish all tables; readers see either the old release or the new one."""
    tables = curated_build(
        raw["items"], raw["permits_all"], raw["permits_active"], raw["atc"], built_at, **options
    )
    publish_release(spark, tables, root, release)


def quality_report(tables: dict[str, DataFrame], code_set: DataFrame, alias_uses: DataFrame | None = None) -> dict[str, DataFrame]:
    summary = Q.coverage_summary(
        tables["products"],
        tables["product_ingredients"],
        tables["links"],
        tables["atc"],
        code_set,
        tables["reviews"],
        alias_uses,
    )
    return {
        "summary": summary,
        "top_mismatches": Q.newest_mismatches(tables["reviews"], 10),
        "mismatch_export": Q.newest_mismatches(tables["reviews"], 200),
    }
