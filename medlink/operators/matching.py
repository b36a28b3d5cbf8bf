"""Resolve text lines to products and ingredients.

Shape of the work, chosen for very large line tables:

* Lines are first reduced to distinct texts (a combined aggregate), so a line
  repeated a billion times is matched once.
* A dictionary is asked through its index (match_index), which is stored once per
  release; a plain Dictionary works too, its index is then part of the plan.
* The five exact passes share one equi join on (method, key).
* Coverage passes (all tokens of a name inside the line) join on the two rarest
  stems of the name, then verify; ratio passes probe pairs of the rarest stems a
  match must contain.  Both are exact, and no stem list is cut.
* All passes are unioned and reduced with one aggregate per text.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V
from medlink.functions import text as T
from medlink.functions.ocr_text import clean_head, clean_tail, line_key, strip_dosage_tail, trailing_code
from medlink.operators.curate import with_name_keys
from medlink.operators.keyed import checkpointed, distinct_values, left_lookup, spread_join
from medlink.operators.match_index import (
    GRAM,
    NO_WORD,
    WHOLE,
    Dictionary,
    MatchIndex,
    as_index,
    clean_stem_table,
    grams,
    newest_first,
)

PRODUCT_METHODS = ("product_exact", "ocr_product", "product_token_contain", "cjk_fuzzy")
PRODUCT_IDS_ORDER = ("product_exact", "ocr_product", "cjk_fuzzy", "product_token_contain")
SINGLE_METHODS = ("canonical_exact", "alias_exact", "paren_alias_exact", "ingredient_token")
#: The key that each exact method asks for.
EXACT_KEYS = {
    "product_exact": "product_key",
    "ocr_product": "ocr_key",
    "canonical_exact": "normalized",
    "alias_exact": "normalized",
    "paren_alias_exact": "paren",
}
HIT = "input_text string, method string, product_id string, product_name string, has_ids boolean, ingredient_id string"
Known = Dictionary | MatchIndex


# --- line preparation ---------------------------------------------------------


def distinct_texts(lines: DataFrame) -> DataFrame:
    return distinct_values(lines.where(F.col("input_text").isNotNull()), "input_text")


def line_keys(texts: DataFrame, normalize_han: bool = False) -> DataFrame:
    """The exact-match keys of each text."""
    source = T.normalize_cjk("input_text") if normalize_han else F.col("input_text")
    return texts.select(
        "input_text",
        T.normalize_text_sql(source).alias("normalized"),
        T.normalize_text_sql(T.paren_slice(source)).alias("paren"),
        T.paren_slice(source).isNotNull().alias("_has_paren"),
        T.normalize_text_sql(F.regexp_replace(source, "[()]", "")).alias("product_key"),
        line_key(source).alias("ocr_key"),
    ).select(
        "input_text", "normalized", F.when(F.col("_has_paren"), F.col("paren")).alias("paren"), "product_key", "ocr_key"
    )


def ocr_cleaned(texts: DataFrame, known_tokens: DataFrame, upper: bool = False) -> DataFrame:
    """(input_text, cleaned): the last short code is dropped unless it is a known token."""
    headed = texts.withColumn("_head", clean_head("input_text")).withColumn("_code", trailing_code("_head"))
    known = known_tokens.select(F.col("token").alias("_code")).distinct().withColumn("_known", F.lit(True))
    flagged = left_lookup(headed, known, "_code", "input_text")
    cleaned = clean_tail("_head", F.col("_code").isNotNull() & F.col("_known").isNull())
    return flagged.select("input_text", (F.upper(cleaned) if upper else cleaned).alias("cleaned"))


# --- exact passes ---------------------------------------------------------------


def exact_hits(texts: DataFrame, d: Known, normalize_han: bool = False, methods: Sequence[str] = tuple(EXACT_KEYS)) -> DataFrame:
    """Answers of the exact ``methods``; only the keys of these are made of a text."""
    keys = line_keys(texts, normalize_han)
    pairs = F.array(*[F.struct(F.lit(m).alias("method"), F.col(EXACT_KEYS[m]).alias("key")) for m in methods])
    probes = keys.select("input_text", F.inline(F.filter(pairs, lambda p: p["key"].isNotNull())))
    return probes.join(as_index(d).exact_keys, ["method", "key"]).drop("key")


# --- coverage by tokens ------------------------------------------------------------


def covered_names(texts: DataFrame, line_stems: Column, postings: DataFrame, partners: DataFrame) -> DataFrame:
    """Names of a cover index whose stems all occur in the text.

    A covered name has its two rarest stems in the line.  For each stem of the line that is some name's rarest, its
    second stems are looked for in the line: those listed, or where they are many, every stem of the line.
    """
    lines = texts.select("*", line_stems.alias("_line"))
    probes = lines.withColumn("key_a", F.explode("_line")).join(partners, "key_a")
    own = F.concat(F.array(F.lit(NO_WORD)), F.array_except("_line", F.array("key_a")))
    seconds = F.when(F.col("partners").isNotNull(), F.array_intersect("partners", own)).otherwise(own)
    pairs = probes.withColumn("key_b", F.explode(seconds)).drop("partners")
    inside = F.size(F.array_except("stems", "_line")) == 0
    return pairs.join(postings, ["key_a", "key_b"]).where(inside).drop("_line", "key_a", "key_b")


def _one_signature(covered: DataFrame, method: str) -> DataFrame:
    """Texts whose candidates share one token signature; the shortest name wins."""
    return (
        covered.groupBy("input_text")
        .agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.min("first").alias("_best"))
        .where(F.col("_lo") == F.col("_hi"))
        .select("input_text", F.lit(method).alias("method"), F.col("_best.ingredient_id").alias("ingredient_id"))
    )


def ingredient_token_hits(texts: DataFrame, d: Known) -> DataFrame:
    index = as_index(d)
    stems = T.word_stems(T.normalize_text_sql("input_text"))
    covered = covered_names(texts, stems, index.ingredient_sets, index.ingredient_partners)
    return _one_signature(covered, "ingredient_token")


def product_contain_hits(texts: DataFrame, d: Known, ratio_percent: int = int(V.TOKEN_CONTAIN_RATIO * 100)) -> DataFrame:
    """The product sharing the most stems with the line, if they are at least 60 % of its tokens.

    A line of n tokens needs m = ceil(0.6 n) shared stems.  Of its k known stems, a product that shares m has at least two
    among the k - m + 2 rarest: only pairs of these are joined.  A line that needs more stems than the largest product
    with one of its stems has is left out, so long lines probe little.  Where one shared stem is enough, the smallest
    product of each stem is a candidate too.
    """
    index = as_index(d)
    words = T.words(T.normalize_text_sql("input_text"))
    lines = texts.select(
        "input_text",
        F.array_distinct(F.transform(words, T.plural_stem)).alias("_line"),
        F.floor((F.size(words) * ratio_percent + 99) / 100).cast("int").alias("_need"),
    ).where(F.col("_need") > 0)
    known = (
        lines.select("input_text", "_need", F.explode("_line").alias("stem"))
        .join(index.overlap_words, "stem")
        .groupBy("input_text", "_need")
        .agg(F.array_sort(F.collect_list(F.struct("df", "stem"))).alias("_ranked"), F.max("largest").alias("_largest"))
        .where((F.size("_ranked") >= F.col("_need")) & (F.col("_largest") >= F.col("_need")))
        .select("input_text", "_need", F.transform("_ranked", lambda x: x["stem"]).alias("_line"))
    )
    first = F.slice("_line", F.lit(1), F.size("_line") - F.greatest(F.col("_need"), F.lit(2)) + 2)
    product = F.struct("product_id", "product_name", "has_ids")
    paired = (
        known.withColumn("_first", first)
        .select("input_text", "_need", "_line", "_first", F.posexplode("_first").alias("_at", "stem_a"))
        .select("input_text", "_need", "_line", "stem_a", F.explode(F.slice(F.col("_first"), F.col("_at") + 2, F.size("_first"))).alias("stem_b"))
        .join(index.overlap_pairs, ["stem_a", "stem_b"])
        .withColumn("_shared", F.size(F.array_intersect("stems", "_line")))
        .where(F.col("_shared") >= F.col("_need"))
        .select("input_text", "_shared", product.alias("_product"))
    )
    single = (
        known.where(F.col("_need") == 1)
        .select("input_text", F.explode("_line").alias("stem"))
        .join(index.overlap_single, "stem")
        .select("input_text", F.lit(1).alias("_shared"), product.alias("_product"))
    )
    best = F.min_by("_product", F.struct(-F.col("_shared"), F.col("_product.product_id"))).alias("_best")
    return (
        paired.unionByName(single)
        .groupBy("input_text")
        .agg(best)
        .select("input_text", F.lit("product_token_contain").alias("method"), "_best.*")
    )


def ocr_clean_hits(texts: DataFrame, d: Known, upper: bool = False, limit: int = V.CLEAN_MAX_INGREDIENTS) -> DataFrame:
    """All ingredients sharing a stem of four or more characters, when there are at most ``limit``.

    A stem that alone belongs to more than ``limit`` ingredients already rules its lines out, so it joins as one marker
    row and its ingredients are never listed.  The index holds the default limit's listing; any other, of fewer, is made
    from it.
    """
    index = as_index(d)
    listing = index.clean_stems
    if limit != V.CLEAN_MAX_INGREDIENTS:
        if limit > V.CLEAN_MAX_INGREDIENTS:
            raise ValueError(f"the index lists at most {V.CLEAN_MAX_INGREDIENTS} ingredients a stem")
        wide = listing.where("ingredient_id is null")
        listing = clean_stem_table(listing.where("ingredient_id is not null"), limit).unionByName(wide)
    stems = F.array_distinct(F.transform(T.words("cleaned", 4), T.plural_stem))
    found = (
        ocr_cleaned(texts, index.tokens, upper)
        .select("input_text", F.explode(stems).alias("token_stem"))
        .join(listing.hint("merge"), "token_stem")
    )
    # At most ``limit`` ids per stem of one text reach this set.
    per_text = found.groupBy("input_text").agg(
        F.collect_set("ingredient_id").alias("_ids"), F.max(F.col("ingredient_id").isNull()).alias("_wide")
    )
    fine = per_text.where(~F.col("_wide") & (F.size("_ids") <= limit))
    return fine.select("input_text", F.lit("ocr_clean").alias("method"), F.explode("_ids").alias("ingredient_id"))


# --- CJK near match -----------------------------------------------------------------


#: Up to so many names of a half's rarest gram are verified one by one; for more, every needle finds its own rarest gram.
HALF_NAMES = 256


def han_segments(texts: DataFrame) -> DataFrame:
    """(input_text, segment): Han runs of three or more characters, and all Han text of the line."""
    cjk = T.extract_cjk("input_text")
    whole = F.filter(F.split(cjk, " "), lambda s: F.length(s) >= 3)
    return texts.where(T.has_cjk("input_text") & (F.length("input_text") >= 3)).select(
        "input_text", F.explode(F.array_union(whole, F.array(cjk))).alias("segment")
    )


def _without(text: Column, i: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1))


def runs_of_names(names: DataFrame, lengths: DataFrame, limit: int) -> DataFrame:
    """(run, name columns): the runs of just these ``lengths`` in each name, with at most ``limit`` + 1 products a run.

    The limit holds where the names lie already, so a run of very many names leaves a task as few rows.
    """
    name, size = F.col("product_name"), F.col("_size")
    places = F.sequence(F.lit(1), F.length(name) - size + 1)
    runs = (
        names.withColumn("_size", F.explode(F.sequence(F.lit(0), F.least(F.length(name), F.lit(WHOLE)))))
        .join(F.broadcast(lengths), "_size", "left_semi")
        .select(*names.columns, F.explode(F.array_distinct(F.transform(places, lambda i: F.substr(name, i, size)))).alias("run"))
    )
    product = F.dense_rank().over(Window.partitionBy("run").orderBy("product_id"))
    return runs.withColumn("_product", product).where(F.col("_product") <= limit + 1).drop("_product")


def near_names(segments: DataFrame, names: DataFrame, limit: int) -> DataFrame:
    """(input_text, name columns) for segments(input_text, segment) of up to WHOLE + 1 characters: names that contain a
    segment with one character left out.

    What is left of a segment is a run of the name, so both meet in one equi join, whatever number of names look alike.
    Of a run in more than ``limit`` products, limit + 1 are given.  (A name that contains the whole segment also contains
    it without its last character.)
    """
    segment, size = F.col("segment"), F.length("segment")
    needles = segments.where(size <= WHOLE + 1).select(
        "input_text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size), lambda i: _without(segment, i)))).alias("run")
    )
    lengths = segments.select((size - 1).alias("_size")).where(F.col("_size") <= WHOLE).distinct()
    return needles.join(runs_of_names(names, lengths, limit).hint("merge"), "run").drop("run")


def near_long_names(segments: DataFrame, names: DataFrame, gram_counts: DataFrame, limit: int) -> DataFrame:
    """(segment, name columns): the same for distinct segments of more than WHOLE + 1 characters; names by gram.

    A segment with more than ``limit`` products has one row without a product.  The character is missing from one half, so
    the other half is whole: names are fetched by that half's rarest gram, then verified.  A segment longer by two than
    all names with that gram is not looked for, so long runs cost no more than their grams.
    """
    segment, size = F.col("segment"), F.length("segment")
    row = names.drop("gram").columns
    blank = {c: F.lit(None).cast(t) for c, t in names.drop("gram").dtypes}
    places = lambda low, high: F.when(high >= low, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<int>"))
    # (segment, side that is whole, its grams)
    half = F.floor(size / 2).cast("int")
    sides = segments.where(size > WHOLE + 1).select(
        "segment",
        F.inline(
            F.array(
                F.struct(F.substr(segment, F.lit(1), half).alias("whole"), (half + 1).alias("low"), size.alias("high")),
                F.struct(F.substr(segment, half + 1).alias("whole"), F.lit(1).alias("low"), half.alias("high")),
            )
        ),
    )
    rarest = (
        sides.select("segment", "low", "high", F.explode(F.array_distinct(grams(F.col("whole"), GRAM))).alias("gram"))
        .join(gram_counts.select("gram", "n_names", "longest"), "gram", "left")
        .groupBy("segment", "low", "high")
        .agg(F.min(F.struct(F.coalesce("n_names", F.lit(0)).alias("n"), "gram", "longest")).alias("_min"))
        .select("segment", "low", "high", "_min.*")
        .where((F.col("n") > 0) & (size - 1 <= F.col("longest")))
    )
    near = F.exists(places(F.col("low"), F.col("high")), lambda i: F.contains("product_name", _without(segment, i)))
    by_half = rarest.where(F.col("n") <= HALF_NAMES).select("segment", "low", "high", "gram").join(names, "gram").where(near).select("segment", *row)
    needles = rarest.where(F.col("n") > HALF_NAMES).select(
        "segment", F.explode(F.array_distinct(F.transform(places(F.col("low"), F.col("high")), lambda i: _without(segment, i)))).alias("needle")
    )
    by_needle = (
        needles.select("segment", "needle", F.explode(F.array_distinct(grams(F.col("needle"), GRAM))).alias("gram"))
        .join(gram_counts.select("gram", "n_names"), "gram", "left")
        .groupBy("segment", "needle")
        .agg(F.min(F.struct(F.coalesce("n_names", F.lit(0)).alias("n"), "gram")).alias("_min"))
        .where(F.col("_min.n") > 0)
        .select("segment", "needle", F.col("_min.gram").alias("gram"))
        .join(names, "gram")
        .where(F.contains("product_name", "needle"))
        .select("segment", *row)
    )
    found = by_half.unionByName(by_needle)
    n = found.groupBy("segment").agg(F.count_distinct("product_id").alias("_n"))
    kept = found.join(n.where(F.col("_n") <= limit).select("segment").hint("merge"), "segment")
    over = n.where(F.col("_n") > limit).select("segment").withColumns(blank)
    return kept.unionByName(over)


def cjk_hits(texts: DataFrame, d: Known, limit: int = V.CJK_MAX_PRODUCTS) -> DataFrame:
    """Products whose CJK name contains a run of the line, one character may be missing.

    A run found in more than ``limit`` products, or runs found in more together, rule the line out.
    """
    index = as_index(d)
    segments = han_segments(texts)
    long = segments.where(F.length("segment") > WHOLE + 1)
    far = near_long_names(long.select("segment").distinct(), index.han_long, index.han_grams, limit)
    answers = near_names(segments, index.han_names, limit).unionByName(long.join(far.hint("merge"), "segment").drop("segment"))
    best = F.min(F.struct(newest_first("product_id", "product_name").alias("order"), "has_ids")).alias("_best")
    return (
        answers.groupBy("input_text")
        .agg(
            F.size(F.collect_set("product_id")).alias("_n"),  # a few for each run
            F.max(F.col("product_id").isNull()).alias("_over"),
            best,
        )
        .where(~F.col("_over") & (F.col("_n") <= limit))
        .select("input_text", F.lit("cjk_fuzzy").alias("method"), "_best.order.product_id", "_best.order.product_name", "_best.has_ids")
    )


# --- cascade ---------------------------------------------------------------------


def _as_hit(df: DataFrame) -> DataFrame:
    want = [part.split(" ") for part in HIT.split(", ")]
    return df.select(
        *[(F.col(n) if n in df.columns else F.lit(None)).cast(t).alias(n) for n, t in want]
    )


def all_hits(texts: DataFrame, d: Known, upper: bool = False, normalize_han: bool = False) -> DataFrame:
    d = as_index(d)
    passes = (
        exact_hits(texts, d, normalize_han),
        ingredient_token_hits(texts, d),
        product_contain_hits(texts, d),
        ocr_clean_hits(texts, d, upper),
        cjk_hits(texts, d),
    )
    out = _as_hit(passes[0])
    for hits in passes[1:]:
        out = out.unionByName(_as_hit(hits))
    return out


def _rank(methods: Sequence[str]) -> Column:
    out = F.when(F.lit(False), 0)
    for i, m in enumerate(methods):
        out = out.when(F.col("method") == m, i)
    return out


def resolve_texts(hits: DataFrame, ids_policy: str = "mixed") -> DataFrame:
    """One row per text: method, confidence, product and where its ingredients come from.

    ``mixed`` (the default) takes the method in pass order but the ingredients in
    another order: the product's, else every clean-up hit, else the single one.
    ``by_method`` takes both from the winning pass.
    """
    if ids_policy not in ("mixed", "by_method"):
        raise ValueError(f"unknown ids policy {ids_policy!r}")
    confidence = F.when(F.lit(False), 0.0)
    for m, value in V.MATCH_METHODS:
        confidence = confidence.when(F.col("_method") == m, F.lit(value))
    best = hits.groupBy("input_text").agg(
        F.min(F.struct(_rank([m for m, _ in V.MATCH_METHODS]).alias("r"), "method")).alias("_m"),
        F.min_by(F.struct("product_id", "product_name"), _rank(PRODUCT_METHODS)).alias("_p"),
        F.min_by(F.struct("product_id", "has_ids"), _rank(PRODUCT_IDS_ORDER)).alias("_i"),
        F.collect_set(F.when(F.col("method") == "ocr_clean", F.col("ingredient_id"))).alias("_clean"),
        F.min_by("ingredient_id", _rank(SINGLE_METHODS)).alias("_single"),
    )
    method = F.col("_m.method")
    by_product, by_clean = F.col("_i.has_ids"), F.size("_clean") > 0
    if ids_policy == "by_method":
        by_product = method.isin(*PRODUCT_METHODS) & F.col("_i.has_ids")
        by_clean = (method == "ocr_clean") & by_clean
        ids_product = F.when(by_product, F.col("_p.product_id"))
    else:
        ids_product = F.when(by_product, F.col("_i.product_id"))
    direct = F.when(F.coalesce(by_product, F.lit(False)), F.array().cast("array<string>")).when(
        by_clean, F.array_sort("_clean")
    )
    direct = direct.otherwise(F.filter(F.array("_single"), lambda x: x.isNotNull()))
    if ids_policy == "by_method":
        direct = F.when(method.isin(*PRODUCT_METHODS), F.array().cast("array<string>")).otherwise(direct)
    return best.select(
        "input_text",
        method.alias("_method"),
        F.col("_p.product_id").alias("product_id"),
        F.col("_p.product_name").alias("product_name"),
        ids_product.alias("_ids_product"),
        direct.alias("_direct"),
    ).withColumn("confidence", confidence)


def match_texts(texts: DataFrame, d: Known, ids_policy: str = "mixed", **options) -> DataFrame:
    """Matched texts, one row per ingredient (one row without ingredient if there is none)."""
    d = as_index(d)
    resolved = resolve_texts(all_hits(texts, d, **options), ids_policy)
    owned = d.owned.select(F.col("product_code").alias("_ids_product"), F.col("ingredient_id").alias("_owned"))
    ids = F.when(F.col("_owned").isNotNull(), F.array("_owned")).otherwise(F.col("_direct"))
    listed = left_lookup(resolved, owned, "_ids_product", "input_text").withColumn("ingredient_id", F.explode_outer(ids))
    return listed.join(d.concept_names, "ingredient_id", "left").select(
        "input_text",
        F.col("_method").alias("match_method"),
        "confidence",
        "product_id",
        "product_name",
        "ingredient_id",
        F.coalesce("canonical_name", "product_name").alias("display_name"),
    )


def match_lines(
    lines: DataFrame,
    d: Known,
    ids_policy: str = "mixed",
    store: Callable[[DataFrame], DataFrame] = checkpointed,
    texts: DataFrame | None = None,
    nested: bool = False,
    **options,
) -> DataFrame:
    """Every input line with its match rows; unmatched lines stay as one row.  ``store`` keeps the distinct texts.

    The join back to the lines is an equi join on the text whose other side has only a
    few rows per text; adaptive skew handling splits a text repeated in many lines.
    ``texts`` are the distinct texts, where they are had for less than by reading the lines.
    ``nested`` gives each line as one row with its match rows as the array ``matches`` (null:
    unmatched), for steps that move lines on; lines of a text stay side by side.
    """
    texts = store(distinct_texts(lines) if texts is None else texts)  # read by every pass
    matched = match_texts(texts, d, ids_policy, **options)
    if nested:
        row = F.struct(*[c for c in matched.columns if c != "input_text"])
        return lines.join(matched.groupBy("input_text").agg(F.collect_list(row).alias("matches")).hint("merge"), "input_text", "left")
    return with_status(lines.join(matched, "input_text", "left"))


def with_status(matches: DataFrame) -> DataFrame:
    return matches.withColumn("match_status", F.when(F.col("match_method").isNotNull(), "matched").otherwise("unmatched"))


def match_rows(nested: DataFrame) -> DataFrame:
    """Nested lines as match_lines gives them without ``nested``."""
    others = [c for c in nested.columns if c != "matches"]
    return with_status(nested.select(*others, F.explode_outer("matches").alias("_match")).select(*others, "_match.*"))


# --- optional passes ----------------------------------------------------------------


def token_splits(stems: DataFrame, stem_col: str, known_stems: DataFrame) -> DataFrame:
    """(stem, left, right): cuts of a stem where both halves are known stems."""
    cuts = (
        stems.select(F.col(stem_col).alias("stem")).distinct().where(F.length("stem") >= 6)
        .select("stem", F.explode(F.sequence(F.lit(3), F.length("stem") - 3)).alias("_at"))
        .select("stem", F.substr("stem", F.lit(1), "_at").alias("left"), F.substr(F.col("stem"), F.col("_at") + 1).alias("right"))
    )
    known = known_stems.select(F.col("token_stem").alias("_k")).distinct()
    return cuts.join(known, F.col("left") == F.col("_k"), "left_semi").join(
        known, F.col("right") == F.col("_k"), "left_semi"
    )


def product_token_hits(texts: DataFrame, d: Known, split_words: bool = False) -> DataFrame:
    """Texts covering all words of exactly one product's name; optionally glued words are cut first."""
    lines = texts.withColumn("_stems", T.word_stems(T.normalize_text_sql("input_text")))
    index = as_index(d)
    if split_words:
        known = index.product_sets.select(F.explode("stems").alias("token_stem"))
        halves = token_splits(lines.select(F.explode("_stems").alias("stem")), "stem", known)
        extra = (
            lines.select("input_text", F.explode("_stems").alias("stem"))
            .join(halves, "stem")
            .groupBy("input_text")
            .agg(F.array_union(F.collect_set("left"), F.collect_set("right")).alias("_extra"))
        )
        lines = lines.join(extra, "input_text", "left").withColumn(
            "_stems", F.when(F.col("_extra").isNotNull(), F.array_union("_stems", "_extra")).otherwise(F.col("_stems"))
        )
    covered = covered_names(lines.select("input_text", "_stems"), F.col("_stems"), index.product_sets, index.product_partners)
    return (
        covered.groupBy("input_text")
        .agg(
            F.min("product_id").alias("product_id"),
            F.max("last_product_id").alias("_hi"),
            F.min("product_name").alias("product_name"),
        )
        .where(F.col("product_id") == F.col("_hi"))
        .select("input_text", F.lit("product_token").alias("method"), "product_id", "product_name", F.lit(0.70).alias("confidence"))
    )


def compound_paren_hits(texts: DataFrame, d: Dictionary) -> DataFrame:
    """Lines like 'x (a & b)': all parts are ingredients and one product holds them all.

    Products are reduced to distinct ingredient sets; a line joins the sets through the
    ingredient of its parts that fewest sets hold.
    """
    parts = F.filter(
        F.transform(F.split(T.paren_slice("input_text"), r"\s*(?:&|and)\s*"), lambda p: F.trim(p)),
        lambda p: F.length(p) >= 2,
    )
    keys = F.array_distinct(F.transform(parts, lambda p: T.normalize_cjk(T.normalize_text_sql(p))))
    lines = texts.select("input_text", keys.alias("_keys")).where(F.size("_keys") > 0)
    ids = d.concepts.select(F.col("canonical_name_normalized").alias("_key"), "ingredient_id")
    wanted = (
        lines.select("input_text", F.size("_keys").alias("_n"), F.explode("_keys").alias("_key"))
        .join(ids, "_key")
        .groupBy("input_text", "_n")
        .agg(F.collect_set("ingredient_id").alias("_ids"))
        .where(F.size("_ids") == F.col("_n"))
    )
    sets = (
        d.product_ingredients.join(wanted.select(F.explode("_ids").alias("ingredient_id")).distinct(), "ingredient_id", "left_semi")
        .groupBy("product_code")
        .agg(F.array_sort(F.collect_set("ingredient_id")).alias("_set"))
        .groupBy("_set")
        .agg(F.min("product_code").alias("product_id"), F.count(F.lit(1)).alias("_products"))
    )
    posting = sets.withColumn("ingredient_id", F.explode("_set"))
    frequency = posting.groupBy("ingredient_id").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (
        wanted.select("input_text", "_ids", F.explode("_ids").alias("ingredient_id"))
        .join(frequency, "ingredient_id")
        .groupBy("input_text", "_ids")
        .agg(F.min(F.struct("_df", "ingredient_id")).alias("_min"))
        .select("input_text", "_ids", F.col("_min.ingredient_id").alias("ingredient_id"))
    )
    return (
        rarest.join(posting, "ingredient_id")
        .where(F.size(F.array_except("_ids", "_set")) == 0)
        .groupBy("input_text")
        .agg(F.sum("_products").alias("candidates"), F.min("product_id").alias("product_id"))
        .select("input_text", F.lit("compound_paren").alias("method"), "candidates", "product_id", F.lit(0.80).alias("confidence"))
    )


def pharma_stems(words: DataFrame, word_col: str, tokens: DataFrame) -> DataFrame:
    """(word, pharma_stem): spelling table, else an added ending, else cut vowels, else plural stem."""
    distinct = words.select(F.col(word_col).alias("word")).distinct().withColumn("_up", F.upper("word"))
    repair = F.when(F.lit(False), F.lit(""))
    for wrong, right in V.SPELLING_REPAIRS.items():
        repair = repair.when(F.col("_up") == wrong, F.lit(right))
    tries = F.transform(
        F.array(*[F.lit(e) for e in V.CUT_OFF_ENDINGS]),
        lambda e, i: F.struct(i.alias("order"), F.concat(F.col("_up"), e).alias("token")),
    )
    known = tokens.select("token", "token_stem").distinct()
    completed = (
        distinct.select("word", F.inline(tries))
        .join(known, "token")
        .groupBy("word")
        .agg(F.min_by("token_stem", F.struct("order", "token_stem")).alias("_completed"))
    )
    cut = F.regexp_replace("_up", "[IE]+$", "")
    known_stems = tokens.select(F.col("token_stem").alias("_cut")).distinct().withColumn("_hit", F.lit(True))
    return (
        distinct.withColumn("_cut", T.plural_stem(cut))
        .join(completed.hint("merge"), "word", "left")
        .join(known_stems, "_cut", "left")
        .select(
            "word",
            F.coalesce(
                T.plural_stem(repair),
                F.col("_completed"),
                F.when(F.col("_hit"), F.col("_cut")),
                T.plural_stem("_up"),
            ).alias("pharma_stem"),
        )
    )


def strict_clean_hits(texts: DataFrame, d: Known) -> DataFrame:
    """Full token coverage by the cleaned text, plain or pharma stems, one signature."""
    index = as_index(d)
    tokens = index.tokens
    cleaned = ocr_cleaned(texts, tokens).select("input_text", F.array_distinct(T.words("cleaned")).alias("_words"))
    exploded = cleaned.select("input_text", F.explode("_words").alias("word"))
    both = spread_join(exploded, pharma_stems(exploded, "word", tokens), "word", "input_text")
    stemmed = both.groupBy("input_text").agg(
        F.array_union(
            F.collect_set(T.plural_stem("word")), F.collect_set("pharma_stem")
        ).alias("_stems")
    )
    covered = covered_names(stemmed, F.col("_stems"), index.ingredient_sets, index.ingredient_partners)
    return _one_signature(covered, "ocr_clean_strict").withColumn("confidence", F.lit(0.75))


def single_clean_hits(texts: DataFrame, d: Known) -> DataFrame:
    """Clean-up pass that accepts a line only when exactly one ingredient is found."""
    return ocr_clean_hits(texts, d, limit=1)


# --- brand matching ------------------------------------------------------------------


def match_brands(lines: DataFrame, d: Dictionary, key: str = "ocr", alias_key: str = "ocr") -> DataFrame:
    """Brand lines: one (en, zh) name pair behind the key gives product_exact, else alias_exact.

    ``key="upper"`` uses the earlier upper-case normaliser on both sides;
    ``alias_key="normalized"`` compares aliases with the upper-case form.
    """
    upper = key == "upper"
    products = d.products.select("product_code", "name_en", "name_zh")
    pair = F.concat(F.coalesce("name_en", F.lit("")), F.lit("|"), F.coalesce("name_zh", F.lit("")))

    def unique(keyed: DataFrame, prefix: str) -> DataFrame:
        return (
            keyed.groupBy("_key")
            .agg(
                F.min(pair).alias("_lo"),
                F.max(pair).alias("_hi"),
                F.min("product_code").alias(f"{prefix}_product"),
                F.min(F.coalesce("name_en", "name_zh")).alias(f"{prefix}_name"),
                F.min("name_en").alias(f"{prefix}_en"),
                F.min("name_zh").alias(f"{prefix}_zh"),
            )
            .where(F.col("_lo") == F.col("_hi"))
            .drop("_lo", "_hi")
        )

    names = products if upper else with_name_keys(products)
    if upper:
        side = lambda c: T.normalize_text_sql(strip_dosage_tail(F.coalesce(c, F.lit(""))))
        names = products.withColumns({"ocr_key_en": side("name_en"), "ocr_key_zh": side("name_zh")})
        text_key = T.normalize_text_sql(strip_dosage_tail("input_text"))
    else:
        text_key = line_key("input_text")
    keyed = names.withColumn("_key", F.explode(F.array_distinct(F.array("ocr_key_en", "ocr_key_zh"))))
    direct = unique(keyed.where(F.length("_key") >= 4), "d")
    by_alias = (
        d.variants.where(F.col("target_type") == "product")
        .select(F.col("normalized_text").alias("_key"), F.col("target_id").alias("product_code"))
        .join(products, "product_code")
    )
    alias = unique(by_alias, "a").withColumnRenamed("_key", "_alias_key")
    texts = distinct_texts(lines).select("input_text", text_key.alias("_key"))
    alias_text = F.col("_key") if alias_key == "ocr" else T.normalize_text_sql("input_text")
    texts = texts.withColumn("_alias_key", F.when(F.length("_key") >= 4, alias_text))
    joined = left_lookup(texts.join(direct, "_key", "left"), alias, "_alias_key", "input_text")
    is_direct, is_alias = F.col("d_product").isNotNull(), F.col("a_product").isNotNull()

    def side_by(name: str) -> Column:
        return F.when(is_direct, F.col(f"d_{name}")).when(is_alias, F.col(f"a_{name}"))

    found = joined.select(
        "input_text",
        F.col("_key").alias("normalized_text"),
        F.when(is_direct | is_alias, "matched").otherwise("unmatched").alias("match_status"),
        side_by("product").alias("product_id"),
        side_by("name").alias("product_name"),
        F.when(is_direct, "product_exact").when(is_alias, "alias_exact").alias("match_method"),
        F.when(is_direct, 0.95).when(is_alias, 0.90).alias("confidence"),
        side_by("zh").alias("name_zh"),
        side_by("en").alias("name_en"),
    )
    return lines.join(found, "input_text", "left")
