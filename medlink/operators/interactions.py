"""Interaction names and pairs, and pair lookup inside ingredient sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V
from medlink.functions import text as T
from medlink.operators.keyed import checkpointed, upsert


#: About so many rows of cases a task.
TASK_ROWS = 1_000_000


def _rank_name(rank: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for name, value in V.SEVERITY_RANK.items():
        out = out.when(rank == value, F.lit(name))
    return out


def severity_templates(spark: SparkSession) -> DataFrame:
    columns = (
        "severity string, patient_title string, patient_message string, staff_title string, "
        "staff_message string, recommended_action string"
    )
    return spark.createDataFrame(list(V.SEVERITY_TEMPLATES), columns).withColumn("disclaimer", F.lit(V.DISCLAIMER))


def manual_name_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(V.MANUAL_NAME_MAP), "drug_name string, ingredient_id string")


def column_of(df: DataFrame, *names: str) -> Column:
    """First of the alternative headers present, ignoring case; null if none is."""
    by_lower = {c.lower(): c for c in df.columns}
    for name in names:
        if name.lower() in by_lower:
            return F.col(f"`{by_lower[name.lower()]}`")
    return F.lit(None).cast("string")


def unique_ids(keyed: DataFrame, key: str) -> DataFrame:
    """(key, lo, hi): lo = hi means exactly one distinct id."""
    return keyed.groupBy(key).agg(F.min("ingredient_id").alias("lo"), F.max("ingredient_id").alias("hi"))


def map_names(names: DataFrame, concepts: DataFrame, aliases: DataFrame) -> DataFrame:
    """Name -> ingredient: the only canonical match, else (if there is no canonical match) the only alias."""
    canonical = unique_ids(
        concepts.select(F.col("canonical_name_normalized").alias("_key"), "ingredient_id"), "_key"
    ).select("_key", F.col("lo").alias("_clo"), F.col("hi").alias("_chi"))
    alias = unique_ids(aliases.select(F.col("normalized_text").alias("_key"), "ingredient_id"), "_key").select(
        "_key", F.col("lo").alias("_alo"), F.col("hi").alias("_ahi")
    )
    joined = (
        names.withColumn("_key", T.normalize_text("drug_name"))
        .join(canonical, "_key", "left")
        .join(alias, "_key", "left")
    )
    by_name = F.col("_clo") == F.col("_chi")
    by_alias = F.col("_clo").isNull() & (F.col("_alo") == F.col("_ahi"))
    return joined.withColumn(
        "ingredient_id", F.when(by_name, F.col("_clo")).when(by_alias, F.col("_alo"))
    ).withColumn(
        "match_method", F.when(by_name, "exact_canonical").when(by_alias, "exact_alias").otherwise("unmapped")
    ).drop("_key", "_clo", "_chi", "_alo", "_ahi")


def build_name_map(
    names: DataFrame, concepts: DataFrame, aliases: DataFrame, existing: DataFrame, force: bool = False
) -> DataFrame:
    """Fresh mapping that keeps hand-made rows unless forced, and keeps old notes."""
    old = existing.select(
        "drug_name",
        F.col("ingredient_id").alias("_old_id"),
        F.col("match_method").alias("_old_method"),
        "notes",
    )
    keep = (F.col("_old_method") == "manual") & F.col("_old_id").isNotNull() & F.lit(not force)
    keep = F.coalesce(keep, F.lit(False))
    return (
        map_names(names, concepts, aliases)
        .join(old, "drug_name", "left")
        .withColumn("ingredient_id", F.when(keep, F.col("_old_id")).otherwise(F.col("ingredient_id")))
        .withColumn("match_method", F.when(keep, "manual").otherwise(F.col("match_method")))
        .drop("_old_id", "_old_method")
    )


def patch_name_map(name_map: DataFrame, patches: DataFrame, force: bool = False) -> DataFrame:
    """Upsert hand-made mappings; names that already have an ingredient stay unless forced."""
    current = name_map.select("drug_name", "source_ids", "occurrences", F.col("ingredient_id").alias("_old"))
    todo = patches.join(current, "drug_name", "left").where(F.lit(force) | F.col("_old").isNull())
    rows = todo.select(
        "drug_name",
        "source_ids",
        "occurrences",
        "ingredient_id",
        F.lit("manual").alias("match_method"),
        F.lit(V.MANUAL_NOTE).alias("notes"),
    )
    return upsert(name_map, rows, ["drug_name"])


def map_pair_ends(pairs: DataFrame, name_map: DataFrame) -> DataFrame:
    """Pairs of names to ordered pairs of ids; rows with an unmapped or equal end are dropped."""
    # files of names are small for their rows: they are not broadcast
    ids = name_map.where(F.col("ingredient_id").isNotNull()).select("drug_name", "ingredient_id").hint("merge")
    side = lambda end: ids.select(F.col("drug_name").alias(f"_n{end}"), F.col("ingredient_id").alias(f"_{end}"))
    joined = (
        pairs.withColumns({"_na": F.trim("drug_a"), "_nb": F.trim("drug_b")})
        .join(side("a"), "_na")
        .join(side("b"), "_nb")
        .where(F.col("_a") != F.col("_b"))
    )
    return joined.select(
        F.least("_a", "_b").alias("ingredient_a"),
        F.greatest("_a", "_b").alias("ingredient_b"),
        T.severity_name("severity").alias("severity"),
        T.source_list("sources").alias("sources"),
        F.coalesce(T.parse_int("raw_rows"), F.lit(0)).alias("raw_rows"),
    )


def fold_pairs(pairs: DataFrame) -> DataFrame:
    """One row per pair: highest severity, union of sources, summed rows; all map-side combined."""
    # one row per pair and single source first, so a pair gathers names of sources and no raw texts
    single = (
        pairs.select(
            "ingredient_a",
            "ingredient_b",
            T.severity_rank("severity").alias("_rank"),
            "raw_rows",
            F.posexplode_outer(F.split("sources", ";")).alias("_at", "_source"),
        )
        .groupBy("ingredient_a", "ingredient_b", "_source")
        .agg(F.max("_rank").alias("_rank"), F.sum(F.when(F.coalesce("_at", F.lit(0)) == 0, F.col("raw_rows"))).alias("raw_rows"))
    )
    return (
        single.groupBy("ingredient_a", "ingredient_b")
        .agg(
            F.max("_rank").alias("_rank"),
            F.nullif(F.array_join(F.array_sort(F.collect_set("_source")), ";"), F.lit("")).alias("sources"),
            F.sum("raw_rows").alias("raw_rows"),
        )
        .withColumn("severity", _rank_name(F.col("_rank")))
        .drop("_rank")
    )


def import_pairs(
    pairs: DataFrame, name_map: DataFrame, existing: DataFrame | None = None, merge_existing: bool = False
) -> DataFrame:
    folded = fold_pairs(map_pair_ends(pairs, name_map))
    if existing is None:
        return folded
    if merge_existing:
        return fold_pairs(folded.unionByName(existing))
    return upsert(existing, folded, ["ingredient_a", "ingredient_b"])


def severity_counts(pairs: DataFrame, severity: str = "severity") -> DataFrame:
    """Rows per severity, every level present."""
    spark = pairs.sparkSession
    levels = spark.createDataFrame([(s,) for s in V.SEVERITY_RANK], f"{severity} string")
    counted = pairs.groupBy(severity).agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counted, severity, "left").select(severity, F.coalesce("n", F.lit(0)).alias("n"))


def mapping_coverage(name_map: DataFrame) -> DataFrame:
    mapped = F.count("ingredient_id")
    return name_map.agg(
        F.count(F.lit(1)).alias("names"),
        mapped.alias("mapped"),
        T.percent_text(mapped, F.count(F.lit(1))).alias("mapped_pct"),
    )


def top_unmapped(name_map: DataFrame, limit: int = 100) -> DataFrame:
    return (
        name_map.where(F.col("ingredient_id").isNull())
        .select("drug_name", F.coalesce("occurrences", F.lit(0)).alias("occurrences"), "source_ids")
        .orderBy(F.desc("occurrences"), F.lower("drug_name"), "drug_name")
        .limit(limit)
    )


def pairs_in_sets(
    sets: DataFrame, pairs: DataFrame, set_key: str = "case_id", id_col: str = "ingredient_id", small_set: int = 64
) -> DataFrame:
    """Known pairs with both ends in the same set.

    Members that are an end of no known pair go first.  A set with up to ``small_set`` others is kept as one array, whose
    at most small_set ** 2 / 2 pairs are looked up by an equi join.  Members of larger sets are probed by the known pairs
    (see probe_sets).  Both ways give the same rows, whatever ``small_set`` is.
    """
    pairs = checkpointed(pairs)  # read by three branches
    ends = pairs.select(F.explode(F.array("ingredient_a", "ingredient_b")).alias("_id")).distinct()
    members = sets.select(set_key, F.col(id_col).alias("_id")).where(F.col("_id").isNotNull()).distinct()
    members = checkpointed(members.join(ends, "_id", "left_semi"))
    sizes = members.groupBy(set_key).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.where(F.col("_n") > small_set).select(set_key)
    small = sizes.where(F.col("_n").between(2, small_set)).select(set_key)
    listed = members.join(small, set_key, "left_semi").groupBy(set_key).agg(F.array_sort(F.collect_list("_id")).alias("_ids"))
    built = F.flatten(
        F.transform(
            "_ids",
            lambda a, i: F.transform(
                F.slice("_ids", i + 2, F.greatest(F.size("_ids") - i - 1, F.lit(0))),
                lambda b: F.struct(a.alias("ingredient_a"), b.alias("ingredient_b")),
            ),
        )
    )
    inside = listed.select(set_key, F.inline(built)).join(
        pairs.withColumns(
            {"_swap": F.col("ingredient_a") > F.col("ingredient_b"), "_a": F.least("ingredient_a", "ingredient_b"), "_b": F.greatest("ingredient_a", "ingredient_b")}
        ).drop("ingredient_a", "ingredient_b").withColumnsRenamed({"_a": "ingredient_a", "_b": "ingredient_b"}),
        ["ingredient_a", "ingredient_b"],
    )
    first, second = F.col("ingredient_a"), F.col("ingredient_b")
    inside = inside.select(
        *[
            F.when(F.col("_swap"), second).otherwise(first).alias(c) if c == "ingredient_a"
            else F.when(F.col("_swap"), first).otherwise(second).alias(c) if c == "ingredient_b"
            else F.col(c)
            for c in [set_key, *pairs.columns]
        ]
    )
    probed = probe_sets(members.join(large, set_key, "left_semi"), pairs, set_key)
    return inside.unionByName(probed.select(*inside.columns))


def probe_sets(members: DataFrame, pairs: DataFrame, set_key: str) -> DataFrame:
    """Each known pair probes members(set_key, _id) through the end found in fewer sets, then checks the other end."""
    frequency = members.groupBy("_id").agg(F.count(F.lit(1)).alias("_n"))
    both = (
        pairs.join(frequency.select(F.col("_id").alias("ingredient_a"), F.col("_n").alias("_na")), "ingredient_a")
        .join(frequency.select(F.col("_id").alias("ingredient_b"), F.col("_n").alias("_nb")), "ingredient_b")
    )
    a_first = F.col("_na") <= F.col("_nb")
    probes = both.withColumns(
        {
            "_probe": F.when(a_first, F.col("ingredient_a")).otherwise(F.col("ingredient_b")),
            "_other": F.when(a_first, F.col("ingredient_b")).otherwise(F.col("ingredient_a")),
        }
    ).drop("_na", "_nb")
    near = probes.join(members.withColumnRenamed("_id", "_probe"), "_probe")
    return near.join(members.withColumnRenamed("_id", "_other"), [set_key, "_other"], "left_semi").drop(
        "_probe", "_other"
    )


def interactions(sets: DataFrame, pairs: DataFrame, templates: DataFrame, set_key: str = "case_id") -> DataFrame:
    found = pairs_in_sets(sets, pairs.select("ingredient_a", "ingredient_b", "severity"), set_key)
    return found.join(templates, "severity")


def by_severity() -> list[Column]:
    """Order of interactions: major first, then by ingredients."""
    return [F.desc(T.severity_rank("severity")), F.asc("ingredient_a"), F.asc("ingredient_b")]


def by_name() -> list[Column]:
    """Order of checked ingredients: by name, ignoring case."""
    return [F.lower("canonical_name"), F.asc("canonical_name"), F.asc("ingredient_id")]


def evaluate_cases(
    codes: DataFrame,
    ids: DataFrame,
    texts: DataFrame,
    product_ingredients: DataFrame,
    concepts: DataFrame,
    pairs: DataFrame,
) -> dict[str, DataFrame]:
    """Coverage-aware check of many cases at once.

    codes(case_id, product_code, position), ids(case_id, ingredient_id), texts(case_id, raw_text).
    Returns tables ``checked``, ``unchecked``, ``interactions`` and ``counts``.
    """
    listed = codes.select("case_id", F.trim("product_code").alias("product_code"), "position").where(F.col("product_code") != "")
    # files of products are small for their rows: they are not broadcast
    owned = product_ingredients.select("product_code", "ingredient_id").distinct().withColumn("_known", F.lit(True)).hint("merge")
    source = F.struct(F.col("position").isNull(), "position", "product_code")
    named = listed.join(owned, "product_code", "left").select(
        "case_id", "ingredient_id", F.when(F.col("_known").isNull(), F.col("product_code")).alias("_unknown"), source.alias("_source")
    )
    asked = ids.select("case_id", F.trim("ingredient_id").alias("ingredient_id")).where(F.col("ingredient_id") != "")
    # hardly any row repeats, so nothing is combined before the shuffle; tasks get about TASK_ROWS rows, whatever the input
    tasks = max(codes.sparkSession.sparkContext.defaultParallelism, -(-(codes.count() + ids.count()) // TASK_ROWS))
    keys = ["case_id", "ingredient_id", "_unknown"]
    # read by five branches below: written once
    entries = checkpointed(
        named.unionByName(asked, allowMissingColumns=True)
        .repartition(tasks, *keys)
        .groupBy(*keys)
        .agg(F.min("_source")["product_code"].alias("product_code"))
    )
    unknown = entries.where(F.col("_unknown").isNotNull()).select("case_id", "product_code")
    wanted = entries.where(F.col("_unknown").isNull()).drop("_unknown")
    names = concepts.select("ingredient_id", "canonical_name")
    checked = wanted.join(names, "ingredient_id").select("case_id", "ingredient_id", "canonical_name")
    missing = wanted.join(names, "ingredient_id", "left_anti")
    raw = texts.select("case_id", F.trim("raw_text").alias("raw_text")).where(F.col("raw_text") != "").distinct()
    none = F.lit(None).cast("string")
    unchecked = (
        unknown.select("case_id", F.lit("unknown_product").alias("reason"), none.alias("raw_text"), "product_code")
        .unionByName(
            missing.select(
                "case_id",
                F.lit("missing_ingredient_concept").alias("reason"),
                F.col("ingredient_id").alias("raw_text"),
                "product_code",
            )
        )
        .unionByName(
            raw.select("case_id", F.lit("unknown_product").alias("reason"), "raw_text", none.alias("product_code"))
        )
    )
    found = pairs_in_sets(checked, pairs.select("ingredient_a", "ingredient_b", "severity"))
    tag = lambda df, name: df.select("case_id", F.lit(name).alias("_kind"))
    tally = tag(checked, "checked").unionByName(tag(unchecked, "unchecked")).unionByName(tag(found, "found"))
    count = lambda name: F.count_if(F.col("_kind") == name)
    counts = tally.groupBy("case_id").agg(
        count("checked").alias("checked_count"),
        count("unchecked").alias("unchecked_count"),
        count("found").alias("interaction_count"),
    )
    return {"checked": checked, "unchecked": unchecked, "interactions": found, "counts": case_messages(counts)}


def case_messages(counts: DataFrame) -> DataFrame:
    """What to show: cards, 'none found' or a warning; the coverage note always."""
    found, unchecked = F.col("interaction_count"), F.col("unchecked_count")
    return counts.withColumns(
        {
            "state": F.when(found > 0, "interactions").when(unchecked == 0, "none_found").otherwise("incomplete"),
            "message": F.when((found == 0) & (unchecked == 0), V.MESSAGE_NONE_FOUND),
            "warning": F.when(unchecked > 0, V.MESSAGE_UNCHECKED),
            "coverage_note": F.lit(V.COVERAGE_NOTE),
        }
    )
