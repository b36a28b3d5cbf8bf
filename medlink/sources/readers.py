"""Delimited, fixed-width and JSON sources, mapped to typed columns by specification."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from medlink.functions import fixed_values as V
from medlink.functions import text as X
from medlink.sources.quoted import read_quoted

Spec = Sequence[tuple[str, str, str]]
CASTS = {"text": X.clean_text, "decimal": X.parse_decimal, "date": X.parse_date}
TYPES = {"text": "string", "decimal": "decimal(18,6)", "date": "date"}


def read_delimited(
    spark: SparkSession, paths: str | Sequence[str], sep: str | None = None, encoding: str = "UTF-8", line_breaks: bool = True
) -> DataFrame:
    """Text columns by header; ',' for .csv, else '|'; missing values become ''.

    ``line_breaks``: quoted fields may hold line breaks. Files are split all the same, in any encoding (see quoted.py).
    A data set of UTF-8 files known to have none sets it to False, and is read by Spark's own reader.
    """
    listed = [paths] if isinstance(paths, str) else list(paths)
    mark = sep or ("," if listed[0].lower().endswith(".csv") else "|")
    if line_breaks or encoding.upper() not in ("UTF-8", "UTF8"):
        return read_quoted(spark, listed, mark, encoding)
    df = (
        spark.read.option("header", True)
        .option("sep", mark)
        .option("encoding", encoding)
        .option("quote", '"')
        .option("escape", '"')
        .csv(listed)
    )
    return df.na.fill("")


def read_lines(spark: SparkSession, paths: str | Sequence[str], encoding: str = "UTF-8") -> DataFrame:
    """(value) per non-blank line.  Code pages outside Unicode need spark.sql.legacy.javaCharsets=true."""
    listed = [paths] if isinstance(paths, str) else list(paths)
    if encoding.upper().replace("-", "") == "UTF8":
        lines = spark.read.text(listed)
    else:
        # An unused separator keeps the whole line in one column; csv is the reader that decodes per record.
        lines = (
            spark.read.schema("value string").option("encoding", encoding).option("sep", "\u0001")
            .option("quote", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
            .csv(listed)
        )
    return lines.where(F.trim("value") != "")


def map_columns(df: DataFrame, spec: Spec) -> DataFrame:
    """Typed target columns plus the source row as JSON; a header that is absent gives nulls."""
    present = set(df.columns)

    def column(target: str, header: str, kind: str) -> Column:
        raw = F.col(f"`{header}`") if header in present else F.lit(None).cast("string")
        return CASTS[kind](raw).alias(target)

    return df.select(*[column(*entry) for entry in spec], X.row_payload(df).alias("source_payload"))


def empty_frame(spark: SparkSession, spec: Spec) -> DataFrame:
    fields = [T.StructField(t, T._parse_datatype_string(TYPES[k]), True) for t, _, k in spec]
    return spark.createDataFrame([], T.StructType([*fields, T.StructField("source_payload", T.StringType(), True)]))


def parse_history(lines: DataFrame, line_col: str = "value") -> DataFrame:
    """Fixed-width history lines; positions are characters, so the text must be decoded already."""
    line = F.col(line_col)

    def cut(start: int, end: int | None) -> Column:
        size = F.lit(2**31 - 1 - start) if end is None else F.lit(end - start)
        return F.substr(line, F.lit(start + 1), size)

    at = {name: (start, end) for name, start, end in V.HISTORY_SLICES}
    plain = {name: X.clean_text(cut(*span)) for name, span in at.items()}
    block = cut(at["name_en"][0], at["strength_text"][0])
    # The last place where the block pattern matches re-cuts name, pack and ingredient; the
    # pattern runs to the end of the block, so what precedes it is the name.
    last = F.element_at(F.regexp_extract_all(block, F.lit(V.HISTORY_BLOCK), F.lit(0)), -1)
    has_block = F.size(F.regexp_extract_all(block, F.lit(V.HISTORY_BLOCK), F.lit(0))) > 0
    part = lambda g: X.clean_text(F.regexp_extract(last, V.HISTORY_BLOCK, g))
    head = F.substr(block, F.lit(1), F.length(block) - F.length(last))
    name = X.clean_text(head)
    dose = cut(at["strength_text"][0], at["manufacturer_short_name"][0])
    has_dose = dose.rlike(V.HISTORY_STRENGTH)
    dose_part = lambda g: X.clean_text(F.regexp_extract(dose, V.HISTORY_STRENGTH, g))
    code = F.regexp_extract(line, V.HISTORY_ATC, 1)
    return lines.select(
        plain["product_code"].alias("product_code"),
        plain["validation_status"].alias("validation_status"),
        X.parse_decimal(plain["price"]).alias("price"),
        X.parse_date(plain["effective_start"]).alias("effective_start"),
        X.parse_date(plain["effective_end"]).alias("effective_end"),
        F.when(has_block, name).otherwise(plain["name_en"]).alias("name_en"),
        X.parse_decimal(F.when(has_block, part(1)).otherwise(plain["package_quantity"])).alias("package_quantity"),
        F.when(has_block, part(2)).otherwise(plain["package_unit"]).alias("package_unit"),
        F.when(has_block, part(3)).otherwise(plain["ingredient_text"]).alias("ingredient_text"),
        F.when(has_dose, dose_part(1)).otherwise(plain["strength_text"]).alias("strength_text"),
        F.when(has_dose, dose_part(2)).otherwise(plain["dose_form"]).alias("dose_form"),
        plain["manufacturer_short_name"].alias("manufacturer_short_name"),
        plain["name_zh"].alias("name_zh"),
        plain["search_text"].alias("search_text"),
        plain["manufacturer_name"].alias("manufacturer_name"),
        F.when(code != "", code).otherwise(plain["atc_code"]).alias("atc_code"),
        line.alias("raw_line"),
    )


def code_set(rows: DataFrame, code: str = "product_code") -> DataFrame:
    """Distinct trimmed non-blank codes."""
    return rows.select(F.trim(code).alias(code)).where(F.col(code) != "").distinct()


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """(alias, canonical) from a {canonical: [aliases]} JSON document; a name of two canonicals is an error."""
    raw = spark.read.text(path, wholetext=True).select(
        F.explode(F.from_json("value", "map<string,array<string>>")).alias("canonical", "aliases")
    )
    return check_aliases(
        raw.select("canonical", F.explode(F.array_union(F.array("canonical"), "aliases")).alias("alias"))
    )


def check_aliases(pairs: DataFrame) -> DataFrame:
    from medlink.functions.ingredients import compare_key

    keyed = pairs.select(compare_key("alias").alias("alias"), compare_key("canonical").alias("canonical")).distinct()
    low, high = F.min("canonical"), F.max("canonical")
    clash = F.concat(F.lit("alias of two names: "), F.col("alias"))
    return keyed.groupBy("alias").agg(low.alias("canonical"), high.alias("_high")).select(
        "alias",
        F.when(F.col("canonical") == F.col("_high"), F.col("canonical"))
        .otherwise(F.raise_error(clash).cast("string"))
        .alias("canonical"),
    )


@dataclass(frozen=True)
class Dataset:
    """One importable dataset."""

    key: str
    files: tuple[str, ...]
    table: str
    spec: Spec = ()
    encoding: str = "UTF-8"
    optional: bool = False


# --- fixed values: datasets, in import order ----------------------------------
DATASETS = (
    Dataset("nhi_items", ("A21030000I-E41001-001.csv",), "items", V.ITEM_COLUMNS),
    Dataset("nhi_component_map", ("A21030000I-E41002-002.csv",), "components", V.COMPONENT_COLUMNS, optional=True),
    Dataset("tfda_36", ("36_2.csv",), "permits_all", V.PERMIT_COLUMNS),
    Dataset("tfda_37", ("37_2.csv",), "permits_active", V.PERMIT_COLUMNS),
    Dataset("atc_ddd", ("ATC_DDD_fabkury_merged.csv",), "atc", V.ATC_COLUMNS),
    Dataset("all1", ("all1_11505_1.TXT", "all1_11505_2.TXT"), "code_set", encoding="MS950"),
)


def dataset_keys(name: str = "all") -> list[str]:
    keys = [d.key for d in DATASETS]
    if name == "all":
        return keys
    if name not in keys:
        raise ValueError(f"unknown dataset {name!r}")
    return [name]


def path_exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target))


def find_files(spark: SparkSession, dataset: Dataset, roots: Sequence[str]) -> list[str]:
    """Full paths of a dataset's files under the first root holding each; a missing required file is an error."""
    found, missing = [], []
    for name in dataset.files:
        hit = next((p for p in (f"{r.rstrip('/')}/{name}" for r in roots) if path_exists(spark, p)), None)
        (found if hit else missing).append(hit or name)
    if missing and not dataset.optional:
        raise FileNotFoundError(f"{dataset.key}: missing {', '.join(missing)}")
    return found


def read_dataset(spark: SparkSession, key: str, roots: Sequence[str]) -> DataFrame:
    """One dataset as typed rows; all its files in one scan; an absent optional one is empty."""
    dataset = next(d for d in DATASETS if d.key == key)
    files = find_files(spark, dataset, roots)
    if dataset.table == "code_set":
        return code_set(parse_history(read_lines(spark, files, dataset.encoding)))
    if not files:
        return empty_frame(spark, dataset.spec)
    return map_columns(read_delimited(spark, files, encoding=dataset.encoding), dataset.spec)
