"""Coverage metrics, rule checks and counts."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.functions import text as T

FLAGS = ("is_product", "has_ingredients", "has_permit", "has_atc", "atc_known", "in_code_set")


def _flagged(df: DataFrame, code: Column, **flags: Column) -> DataFrame:
    zero = F.lit(0)
    return df.select(code.alias("code"), *[flags.get(f, zero).cast("int").alias(f) for f in FLAGS])


def coverage_summary(
    products: DataFrame,
    product_ingredients: DataFrame,
    links: DataFrame,
    atc_latest: DataFrame,
    code_set: DataFrame,
    reviews: DataFrame,
    alias_uses: DataFrame | None = None,
) -> DataFrame:
    """One row of coverage counts and percentages over distinct product codes.

    Every input is reduced to flags per code; one shuffle on the code merges them.
    """
    one = F.lit(1)
    code = F.col("product_code")
    known_atc = atc_latest.select("atc_code").distinct().withColumn("_k", one)
    with_atc = products.where(F.col("atc_code") != "").join(known_atc, "atc_code")
    rows = (
        _flagged(products, code, is_product=one, has_atc=F.coalesce(F.col("atc_code") != "", F.lit(False)))
        .unionByName(_flagged(with_atc, code, atc_known=one))
        .unionByName(_flagged(product_ingredients, code, has_ingredients=one))
        .unionByName(_flagged(links, code, has_permit=one))
        .unionByName(_flagged(code_set, code, in_code_set=one))
        .where(F.col("code") != "")
    )
    per_code = rows.groupBy("code").agg(*[F.max(f).alias(f) for f in FLAGS])
    both = lambda f: F.sum(F.col("is_product") * F.col(f))
    sums = per_code.agg(
        F.sum("is_product").alias("products"),
        both("has_ingredients").alias("with_ingredients"),
        both("has_permit").alias("with_permit"),
        both("has_atc").alias("with_atc"),
        both("atc_known").alias("with_known_atc"),
        F.sum("in_code_set").alias("code_set_size"),
        both("in_code_set").alias("overlap"),
        F.lit(0).cast("long").alias("review_items"),
        F.lit(0).cast("long").alias("alias_uses"),
    )
    parts = [reviews.agg(F.count(F.lit(1)).alias("review_items"))]
    if alias_uses is not None:
        parts.append(alias_uses.agg(F.sum("uses").alias("alias_uses")))
    for part in parts:
        sums = sums.unionByName(part, allowMissingColumns=True)
    total = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums.columns])
    n = F.col("products")
    pct = lambda c: T.percent_text(F.col(c), n)
    return total.withColumns(
        {
            "with_ingredients_pct": pct("with_ingredients"),
            "with_permit_pct": pct("with_permit"),
            "with_atc_pct": pct("with_atc"),
            "with_known_atc_pct": pct("with_known_atc"),
            "overlap_pct": pct("overlap"),
            "code_set_only": F.col("code_set_size") - F.col("overlap"),
        }
    )


def newest_mismatches(reviews: DataFrame, limit: int = 200) -> DataFrame:
    """Newest mismatch rows: a bounded top-k report."""
    return (
        reviews.where(F.col("source") == "tfda_mismatch")
        .orderBy(F.desc("created_at"), F.asc("review_id"))
        .limit(limit)
    )


@dataclass(frozen=True)
class Rule:
    """One data-quality rule: what is checked and the frame of violations (one row each)."""

    name: str
    violations: DataFrame = field(repr=False)


def unique_rule(name: str, df: DataFrame, keys: Sequence[str]) -> Rule:
    return Rule(name, df.groupBy(*keys).count().where(F.col("count") > 1))


def not_null_rule(name: str, df: DataFrame, column: str) -> Rule:
    return Rule(name, df.where(F.col(column).isNull()))


def check_rule(name: str, df: DataFrame, condition: Column) -> Rule:
    return Rule(name, df.where(~condition))


def reference_rule(name: str, df: DataFrame, column: str, target: DataFrame, target_column: str) -> Rule:
    known = target.select(F.col(target_column).alias(column)).distinct()
    return Rule(name, df.where(F.col(column).isNotNull()).join(known, column, "left_anti"))


def run_rules(rules: Sequence[Rule]) -> DataFrame:
    """(rule, violations) in one job."""
    out = None
    for rule in rules:
        row = rule.violations.agg(F.count(F.lit(1)).alias("violations")).select(
            F.lit(rule.name).alias("rule"), "violations"
        )
        out = row if out is None else out.unionByName(row)
    return out


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        out = row if out is None else out.unionByName(row)
    return out


def code_set_relations(left: DataFrame, right: DataFrame, code: str) -> DataFrame:
    """Each distinct code with its side: both, left_only or right_only (one shuffle)."""
    sides = left.select(code, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(code, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    merged = sides.groupBy(code).agg(F.max("_l").alias("_l"), F.max("_r").alias("_r"))
    side = F.when(F.col("_l") + F.col("_r") == 2, "both").when(F.col("_l") == 1, "left_only").otherwise("right_only")
    return merged.select(code, side.alias("side"))
