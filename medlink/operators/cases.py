"""Case roll-ups: detected items, display groups, case groups, summaries and shared records.

Results are rows, not nested documents: one row per card, per group or per item, so a
case (or case group) of any size stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlink.functions import ocr_text as O
from medlink.functions import text as T
from medlink.functions.case_fields import first_line
from medlink.functions import fixed_values as V
from medlink.functions.patterns import ascii_bounds
from medlink.operators.keyed import checkpointed, chunked_lists, pick, positions
from medlink.operators.matching import match_rows

#: Lines of cases that a task gets.
TASK_LINES = 500_000
ITEM = "case_id, input_index, raw_text, display_name, match_status, ingredient_id, match_method, confidence, product_code"


def candidate_lines(
    grouped: Column, section: Column, other: Column, fallback: Column, medication_name: Column
) -> Column:
    """Lines to match, per case row: the first non-empty source, the known name first, section lines last."""
    texts = F.filter(F.transform(section, lambda x: F.trim(x)), lambda x: x != "")
    others = F.transform(
        F.filter(other, O.is_usable_other_line), lambda x: F.trim(F.regexp_replace(x, r"\|", " "))
    )
    others = F.filter(others, lambda x: x != "")
    base = F.when(F.size(grouped) > 0, grouped).when(F.size(texts) > 0, texts)
    base = base.when(F.size(others) > 0, others).otherwise(F.coalesce(fallback, F.array().cast("array<string>")))
    name = F.trim(F.coalesce(medication_name, F.lit("")))
    led = F.when((name != "") & ~F.array_contains(base, name), F.concat(F.array(name), base)).otherwise(base)
    missing = F.array_distinct(F.filter(texts, lambda x: ~F.array_contains(led, x)))
    return F.transform(F.concat(led, missing), O.strip_non_medication)


def brand_ingredients(brands: DataFrame, product_ingredients: DataFrame) -> DataFrame:
    """(brand product, ingredient) rows for the matched brands."""
    wanted = brands.where(F.col("product_id").isNotNull()).select(F.col("product_id").alias("product_code")).distinct()
    return product_ingredients.select("product_code", "ingredient_id").distinct().join(wanted, "product_code", "left_semi")


def brand_display(zh: Column | str, en: Column | str, fallback: Column | str) -> Column:
    z, e = T.clean_text(zh), T.clean_text(en)
    return F.when(z.isNotNull() & e.isNotNull(), F.concat(z, F.lit(" ("), e, F.lit(")"))).otherwise(
        F.coalesce(z, e, T.col(fallback))
    )


def detected_items(
    matches: DataFrame,
    brands: DataFrame | None = None,
    brand_map: DataFrame | None = None,
    medication_names: DataFrame | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """One card per (case, ingredient); a case without any match gives brand cards, else one text card.

    ``matches`` holds every line of every case, as ``match_lines`` returns them, nested or not; they
    are read once.  A single aggregate per (case, ingredient) keeps the first line of each
    card and, where there is no ingredient, the longest line of the case.  Where every case
    fits a task, ``tasks`` brings its lines together in one of so many, in one shuffle of lines
    as they are; otherwise cards are reduced where the lines lie, which moves wider rows twice.
    """
    if tasks is not None:
        matches = matches.repartition(tasks, "case_id")
    if "matches" in matches.columns:
        matches = match_rows(matches)
    matched = (F.col("match_status") == "matched") & F.col("ingredient_id").isNotNull()
    rows = matches.select(
        "case_id",
        "input_index",
        F.col("input_text").alias("raw_text"),
        F.coalesce("product_name", "display_name", "input_text").alias("display_name"),
        F.when(matched, "matched").otherwise("unmatched").alias("match_status"),
        F.when(matched, F.col("ingredient_id")).alias("ingredient_id"),
        "match_method",
        "confidence",
        F.col("product_id").alias("product_code"),
    )
    loose = F.col("ingredient_id").isNull()
    ties = [F.col(c) for c in ("input_index", "raw_text", "display_name", "match_method", "product_code")]
    rows = rows.where(~loose | (F.length("raw_text") > 0))
    best = pick(rows, ["case_id", "ingredient_id"], [F.when(loose, -F.length("raw_text")).otherwise(F.lit(0)), *ties])
    any_match = F.max(~loose).over(Window.partitionBy("case_id"))
    cards = best.withColumn("_any", any_match).where(~loose | ~F.col("_any"))
    none = F.lit(None).cast("string")
    as_text = lambda df: df.withColumns(
        {
            "display_name": F.col("raw_text"),
            "match_method": none,
            "confidence": F.lit(None).cast("double"),
            "product_code": none,
        }
    )
    columns = ITEM.split(", ")
    if brands is None and medication_names is None:
        text = lambda c: F.when(~loose, F.col(c))
        shown = F.when(loose, F.col("raw_text")).otherwise(F.col("display_name"))
        return cards.withColumns(
            {"display_name": shown, **{c: text(c) for c in ("match_method", "confidence", "product_code")}}
        ).select(columns)
    cards = checkpointed(cards.drop("_any"))
    out = cards.where(~loose).select(columns)
    open_cases = cards.where(loose)
    if brands is not None and brand_map is not None:
        named = brands.where((F.col("match_status") == "matched") & F.col("product_id").isNotNull())
        of_brand = (
            named.join(open_cases.select("case_id"), "case_id", "left_semi")
            .withColumnRenamed("product_id", "product_code")
            .join(brand_map, "product_code")
            .select(
                "case_id",
                "input_index",
                F.col("input_text").alias("raw_text"),
                F.coalesce("product_name", "input_text").alias("display_name"),
                F.lit("matched").alias("match_status"),
                "ingredient_id",
                "match_method",
                "confidence",
                "product_code",
            )
        )
        brand_cards = pick(of_brand, ["case_id", "ingredient_id"], ties).select(columns)
        out = out.unionByName(brand_cards)
        open_cases = open_cases.join(brand_cards.select("case_id").distinct(), "case_id", "left_anti")
    if medication_names is not None:
        names = medication_names.select("case_id", T.clean_text("medication_name").alias("_name"))
        open_cases = (
            open_cases.join(names, "case_id", "left")
            .withColumn("raw_text", F.coalesce("_name", "raw_text"))
            .drop("_name")
        )
    return out.unionByName(as_text(open_cases).select(columns))


def case_ingredients(matches: DataFrame) -> DataFrame:
    return matches.where(F.col("ingredient_id").isNotNull()).select("case_id", "ingredient_id").distinct()


def looks_medical(c: Column | str, literal_escape: bool = False) -> Column:
    """Is an unmatched text about a medicine?  ``literal_escape`` keeps only the two tests without escapes."""
    text = T.col(c)
    tests = text.rlike(V.CJK_FORM) | (text.rlike("[A-Za-z]") & (F.length(text) >= 6))
    if literal_escape:
        return tests
    return (
        text.rlike(ascii_bounds(r"(?i)\b\d+(\.\d+)?\s*(mcg|mg|g|ml|iu|%)\b"))
        | text.rlike(ascii_bounds(V.CONTAINER_WORD))
        | text.rlike(r"\([^)]*[A-Za-z][^)]*\)")
        | tests
    )


def is_meta_noise(c: Column | str) -> Column:
    """A line about the product or the form: one of the fixed words, in any case, with the spaces as given."""
    lowered, out = F.lower(T.col(c)), F.lit(False)
    for word in V.META_NOISE_WORDS:
        out = out | F.contains(lowered, F.lit(word))
    return out


def display_groups(items: DataFrame) -> DataFrame:
    """(case_id, group_key, match_status, title, confidence, item_count).

    Matched items group by ingredient under their most confident title.  Unmatched items
    join the only matched group of a case; otherwise they form one group of their own.
    """
    matched = (F.col("match_status") == "matched") & F.col("ingredient_id").isNotNull()
    order = [F.col("input_index"), F.col("display_name")]
    best = F.struct(-F.coalesce("confidence", F.lit(-1.0)), *order)
    groups = (
        items.where(matched)
        .groupBy("case_id", F.col("ingredient_id").alias("group_key"))
        .agg(
            F.min_by("display_name", best).alias("title"),
            F.max("confidence").alias("confidence"),
            F.count(F.lit(1)).alias("item_count"),
        )
    )
    loose = items.where(~F.coalesce(matched, F.lit(False))).withColumn(
        "_medical", looks_medical("display_name") & ~is_meta_noise("display_name")
    )
    medical_first = F.struct((~F.col("_medical")).cast("int"), *order)
    other = ~F.col("_medical")
    tally = loose.groupBy("case_id").agg(
        F.count_if("_medical").alias("_medical_n"),
        F.count_if(other).alias("_other_n"),
        F.min_by("display_name", medical_first).alias("_title"),
        F.min_by("display_name", F.when(other, F.struct(*order))).alias("_other_title"),
    )
    shape = groups.groupBy("case_id").agg(F.count(F.lit(1)).alias("_groups"), F.max("group_key").alias("_only"))
    placed = tally.join(shape, "case_id", "left")
    single = F.coalesce(F.col("_groups") == 1, F.lit(False))
    attach = placed.where(single).select("case_id", F.col("_only").alias("group_key"), "_medical_n")
    grown = groups.join(attach, ["case_id", "group_key"], "left").select(
        "case_id",
        "group_key",
        F.lit("matched").alias("match_status"),
        "title",
        "confidence",
        (F.col("item_count") + F.coalesce("_medical_n", F.lit(0))).alias("item_count"),
    )
    rest = placed.where(~single | (F.col("_other_n") > 0)).select(
        "case_id",
        F.when(single, "other").otherwise("unmatched").alias("group_key"),
        F.when(single, "other").otherwise("unmatched").alias("match_status"),
        F.when(single, F.col("_other_title")).otherwise(F.col("_title")).alias("title"),
        F.lit(None).cast("double").alias("confidence"),
        F.when(single, F.col("_other_n")).otherwise(F.col("_medical_n") + F.col("_other_n")).alias("item_count"),
    )
    return grown.unionByName(rest)


def merge_case_groups(items: DataFrame, cases: DataFrame) -> DataFrame:
    """Items of all cases of a group: one per ingredient (earliest case first), unmatched ones all kept.

    cases(case_id, case_group_id, created_at); a case without a group is its own group.
    """
    keyed = items.join(
        cases.select("case_id", F.coalesce("case_group_id", F.col("case_id").cast("string")).alias("group_id"), "created_at"), "case_id"
    )
    matched = F.coalesce((F.col("match_status") == "matched") & F.col("ingredient_id").isNotNull(), F.lit(False))
    once = pick(
        keyed.where(matched),
        ["group_id", "ingredient_id"],
        [F.col("created_at"), F.col("case_id"), F.col("input_index"), F.col("display_name")],
    )
    return once.unionByName(keyed.where(~matched))


def recent_cases(cases: DataFrame, items: DataFrame, limit: int = 20) -> DataFrame:
    """Newest cases with a preview line and their item count; items are counted for those cases only."""
    top = cases.orderBy(F.desc("created_at"), F.asc("case_id")).limit(limit)
    counts = items.join(top.select("case_id"), "case_id", "left_semi").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("item_count")
    )
    return top.join(counts, "case_id", "left").select(
        "case_id", "created_at", first_line("ocr_raw_text").alias("preview"), F.coalesce("item_count", F.lit(0)).alias("item_count")
    )


def shared_summary(shared: DataFrame, records: DataFrame, owners: DataFrame, members: DataFrame) -> dict[str, DataFrame]:
    """Shared records with owner and member count, and the ordered member names in bounded chunks.

    shared(place_id, record_id, owner_id); records(record_id, record_name, created_at);
    owners(owner_id, owner_name); members(record_id, member_name, member_at).
    """
    counts = members.groupBy("record_id").agg(F.count(F.lit(1)).alias("member_count"))
    base = shared.join(records, "record_id").join(owners, "owner_id").join(counts, "record_id", "left")
    summary = base.withColumn("member_count", F.coalesce("member_count", F.lit(0)))
    named = members.join(shared.select("record_id").distinct(), "record_id", "left_semi").where(
        F.col("member_name").isNotNull()
    )
    placed = positions(named, ["record_id"], [F.col("member_at"), F.col("member_name")], "_pos")
    names = chunked_lists(placed, ["record_id"], "_pos", F.col("member_name"), "member_names")
    return {"summary": summary, "names": names}


def shared_detail(shared: DataFrame, members: DataFrame) -> DataFrame:
    return shared.join(members, "record_id", "left")


def stored_fields(response: Column, extracted: Column) -> Column:
    """Fields to store: those of the stored response if there are any, else the extracted ones."""
    return F.coalesce(response, extracted)


def cases_per_photo(submissions: DataFrame) -> DataFrame:
    """One case per photo under one deterministic group id.

    submissions(submission_key, photos array<struct<path, text>>).
    """
    return submissions.select(
        T.name_uuid(F.concat(F.lit("group|"), F.col("submission_key"))).alias("case_group_id"),
        "submission_key",
        F.posexplode("photos").alias("photo_index", "photo"),
    ).select(
        T.name_uuid(F.concat_ws("|", F.lit("case"), "submission_key", F.col("photo_index").cast("string"))).alias(
            "case_id"
        ),
        "case_group_id",
        "photo_index",
        F.col("photo.path").alias("photo_path"),
        F.col("photo.text").alias("ocr_raw_text"),
    )


def combine_photos(photos: DataFrame) -> dict[str, DataFrame]:
    """Per case: the first present case fields, and the photo texts in bounded ordered chunks.

    photos(case_id, photo_index, text, case_fields).
    """
    first = photos.groupBy("case_id").agg(
        F.min_by("case_fields", F.when(F.col("case_fields").isNotNull(), F.struct("photo_index", "case_fields"))).alias("case_fields"),
        F.count(F.lit(1)).alias("photo_count"),
    )
    placed = positions(
        photos.where(F.col("text") != ""), ["case_id"], [F.col("photo_index")], "_pos", F.floor(F.col("photo_index") / 4096)
    )
    chunks = chunked_lists(placed, ["case_id"], "_pos", F.col("text"), "_texts")
    return {"fields": first, "texts": chunks.select("case_id", "chunk_no", F.array_join("_texts", "\n\n").alias("text"))}
