"""Registration of queries beside the SQL they must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """For CPU-heavy row work: use all cores when the scan has fewer splits than cores.

    A large table already has more splits than that and is left as it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- SQL fragments for the comparison side -----------------------------------


def sql_norm(e: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(upper(replace({e}, 'ß', 'SS')), '[^\\p{{L}}\\p{{N}}_\\s]+', ' ', 'g'),"
        " '\\s+', ' ', 'g'))"
    )


def sql_norm_punct(e: str) -> str:
    return (
        f"trim(regexp_replace(regexp_replace(upper(replace({e}, 'ß', 'SS')), '[^\\p{{L}}\\p{{N}}\\s]+', ' ', 'g'),"
        " '\\s+', ' ', 'g'))"
    )


def sql_stem(e: str) -> str:
    return (
        f"CASE WHEN length({e}) <= 3 THEN {e}"
        f" WHEN suffix({e}, 'IES') THEN left({e}, length({e}) - 3) || 'Y'"
        f" WHEN regexp_matches({e}, '[SXZ]ES$') THEN left({e}, length({e}) - 2)"
        f" WHEN regexp_matches({e}, '[^S]S$') THEN left({e}, length({e}) - 1) ELSE {e} END"
    )


def sql_uuid(e: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({e}))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' ||"
        f" translate(substr({h},17,1), '0123456789abcdef', '89ab89ab89ab89ab') || substr({h},18,3) || '-' ||"
        f" substr({h},21,12))"
    )


def sql_spacing(e: str) -> str:
    """Spacing clean-up; the three merge rounds keep RE2's word boundaries (Latin input)."""
    out = f"lower(trim(regexp_replace({e}, '\\s+', ' ', 'g')))"
    out = f"regexp_replace({out}, '(\\d)\\s*\\.\\s*(\\d)', '\\1.\\2', 'g')"
    out = f"trim(regexp_replace({out}, ' \\d+\\.(\\s|$)', ' ', 'g'))"
    for _ in range(3):
        out = f"regexp_replace({out}, '\\b([a-z]{{2,5}}) +([a-z]{{2,5}})\\b', '\\1\\2', 'g')"
    return out


def sql_tail(e: str) -> str:
    out = f"regexp_replace({e}, '(?is)[,，]?\\s*總量\\s*\\d+\\s*[\\x{{4E00}}-\\x{{9FFF}}]{{1,2}}.*$', '')"
    return f"regexp_replace({out}, '(?is)\\b\\d+(\\.\\d+)?\\s*(mcg|mg|g|ml|iu)\\b.*$', '')"


def sql_line_key(e: str) -> str:
    return sql_spacing(sql_tail(sql_spacing(e)))


def sql_name_key(e: str) -> str:
    return sql_spacing(sql_tail(e))
