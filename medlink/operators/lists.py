"""Saved lists: ingredient resolution, base names, duplicates and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlink.functions.ingredients import strip_trailing_dose


def names_starting_with(names: DataFrame, concepts: DataFrame) -> DataFrame:
    """(name, ingredient_id): concepts whose name starts with ``name``, ignoring case.

    An equi join on whole prefixes: each concept offers its prefixes of just the lengths that are asked for, a table of
    at most as many rows as the longest name has characters.
    """
    asked = names.select("name").distinct().where(F.col("name") != "").withColumn("_key", F.lower("name"))
    lengths = asked.select(F.length("_key").alias("_size")).distinct()
    given = (
        concepts.where(F.length("canonical_name") > 0)
        .select("ingredient_id", F.lower("canonical_name").alias("_full"))
        .withColumn("_size", F.explode(F.sequence(F.lit(1), F.length("_full"))))
        .join(F.broadcast(lengths), "_size", "left_semi")
        .select("ingredient_id", F.substr("_full", F.lit(1), F.col("_size")).alias("_key"))
    )
    return asked.join(given, "_key").select("name", "ingredient_id")


def base_ingredients(ids: DataFrame, concepts: DataFrame) -> DataFrame:
    """Replace dose-bearing concepts by their base concept where one exists.

    ``ids`` has ``ingredient_id`` plus any grouping columns; the result is distinct.
    """
    named = concepts.select("ingredient_id", "canonical_name")
    bases = named.groupBy(F.col("canonical_name").alias("_base")).agg(F.min("ingredient_id").alias("_base_id"))
    remap = (
        named.withColumn("_base", strip_trailing_dose("canonical_name"))
        .where(F.col("_base") != F.col("canonical_name"))
        .join(bases, "_base")
        .select("ingredient_id", "_base_id")
    )
    groups = [c for c in ids.columns if c != "ingredient_id"]
    return (
        ids.join(named.select("ingredient_id"), "ingredient_id", "left_semi")
        .join(remap, "ingredient_id", "left")
        .select(*groups, F.coalesce("_base_id", "ingredient_id").alias("ingredient_id"))
        .distinct()
    )


def list_ingredients(items: DataFrame, product_ingredients: DataFrame, concepts: DataFrame) -> DataFrame:
    """(list_id, ingredient_id): by product code, else by name prefix, then mapped to base concepts."""
    # Ids are mapped where products and names are distinct, before lists multiply them: a name has far fewer bases than
    # concepts.  Files of products are small for their rows, so they are not broadcast.
    owned = product_ingredients.select("product_code", "ingredient_id").distinct()
    based = base_ingredients(owned, concepts)
    by_code = items.select("list_id", "product_code").join(based.hint("merge"), "product_code").select("list_id", "ingredient_id")
    coded = items.where(F.col("product_code").isNotNull()).join(
        owned.select("product_code").distinct().hint("merge"), "product_code", "left_anti"
    )
    unresolved = coded.unionByName(items.where(F.col("product_code").isNull()))
    named = unresolved.select("list_id", F.regexp_replace("name_en", "^[\"']|[\"']$", "").alias("name")).distinct()
    starting = base_ingredients(names_starting_with(named, concepts), concepts)
    by_name = named.join(starting.hint("merge"), "name").select("list_id", "ingredient_id")
    return by_code.unionByName(by_name).distinct()


def duplicate_members(candidates: DataFrame, items: DataFrame, product_ingredients: DataFrame) -> DataFrame:
    """List items sharing an ingredient with a candidate product: candidates(list_id, product_code)."""
    owned = product_ingredients.select("product_code", "ingredient_id").distinct()
    wanted = candidates.join(owned, "product_code").select("list_id", "ingredient_id").distinct()
    return (
        items.select("list_id", "product_code").distinct().join(owned, "product_code")
        .join(wanted, ["list_id", "ingredient_id"], "left_semi")
    )


def list_counts(items: DataFrame, key: str = "list_id") -> DataFrame:
    return items.groupBy(key).agg(F.count(F.lit(1)).alias("item_count"))
