"""Text, number, date and id functions on columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, fn) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``fn``.

    Higher-order functions re-evaluate an outer expression wherever it is mentioned,
    once per element inside a lambda; a lambda variable is evaluated once.
    """
    return F.element_at(F.transform(F.array(value), fn), 1)


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def normalize_text(c: Column | str) -> Column:
    """Upper case, every run of non-word characters to one space; null gives ''."""
    upper = F.upper(F.coalesce(col(c), F.lit("")))
    return _squeeze(F.regexp_replace(upper, r"[^\p{L}\p{N}_\s]+", " "))


def normalize_text_sql(c: Column | str) -> Column:
    """As :func:`normalize_text`, but the underscore is punctuation too."""
    upper = F.upper(F.coalesce(col(c), F.lit("")))
    return _squeeze(F.regexp_replace(upper, r"[^\p{L}\p{N}\s]+", " "))


def clean_text(c: Column | str) -> Column:
    """Trim; blank becomes null."""
    return F.nullif(F.regexp_replace(col(c), r"^\s+|\s+$", ""), F.lit(""))


def canonical_name(c: Column | str) -> Column:
    return _squeeze(col(c))


def parse_decimal(c: Column | str, strict: bool = True) -> Column:
    """Number with thousands commas; '', '-' and '--' are null."""
    text = F.regexp_replace(F.trim(col(c).cast("string")), ",", "")
    text = F.when(~text.isin("", "-", "--"), text)
    return text.cast("decimal(18,6)") if strict else text.try_cast("decimal(18,6)")


def parse_date(c: Column | str, strict: bool = True) -> Column:
    """Republic-era digits (6 or 7) first, then ISO, slashes and 8 digits."""
    def parse(text: Column) -> Column:
        era = text.rlike(r"^\d{6,7}$")
        digits = F.length(text) - 4
        year = F.substr(text, F.lit(1), digits).try_cast("int") + 1911
        era_iso = F.concat_ws(
            "-", year.cast("string"), F.substr(text, digits + 1, F.lit(2)), F.substr(text, digits + 3, F.lit(2))
        )
        day = F.when(era, F.try_to_date(era_iso, "yyyy-MM-dd")).otherwise(
            F.coalesce(*[F.try_to_date(text, shape) for shape in ("yyyy-M-d", "yyyy/M/d", "yyyyMMdd")])
        )
        if not strict:
            return day
        message = F.concat(F.lit("unsupported date: "), text)
        return F.when(text != "", F.coalesce(day, F.raise_error(message).cast("date")))

    return let(F.trim(col(c)), parse)


def _url_decoded(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _filled(c: Column) -> Column:
    """Blank text becomes null; the expression is evaluated once."""
    return let(c, lambda v: F.when(v != "", v))


def permit_token(c: Column | str) -> Column:
    """Permit number in a link: query value, else path pattern, else last path segment."""

    def from_query(url: Column) -> Column:
        def values(query: Column) -> Column:
            shapes = F.array(*[F.lit(f"(?:^|&){key}=([^&]*)") for key in V.PERMIT_QUERY_KEYS])
            found = F.transform(shapes, lambda shape: F.call_function("regexp_extract", query, shape, F.lit(1)))
            return F.get(F.filter(found, lambda v: v != ""), F.lit(0))

        value = let(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), values)
        return F.trim(let(value, _url_decoded))

    def from_path(raw: Column) -> Column:
        pattern = F.regexp_extract(_url_decoded(raw), V.PERMIT_PATTERN, 0)
        segment = F.trim(let(F.element_at(F.split(raw, "/"), -1), _url_decoded))
        return F.coalesce(_filled(pattern), _filled(segment))

    def token(url: Column) -> Column:
        path = F.regexp_extract(url, r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
        path = F.regexp_replace(F.regexp_replace(path, r";[^/]*$", ""), r"\+", "%2B")
        return F.when(url != "", F.coalesce(from_query(url), let(path, from_path)))

    return let(F.trim(col(c)), token)


def split_clean(c: Column | str, pattern: str) -> Column:
    """Split, trim the parts and drop blank ones; null gives an empty array."""
    parts = F.transform(F.split(F.coalesce(col(c), F.lit("")), pattern), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def split_permit_ingredients(c: Column | str) -> Column:
    return split_clean(c, ";;")


def split_item_ingredients(c: Column | str) -> Column:
    return split_clean(c, r"(?i)\s*(?:;;|,|\+|/| AND )\s*")


def is_combo(c: Column | str) -> Column:
    flag = F.trim(F.coalesce(col(c), F.lit("")))
    return flag.contains(V.COMBO_MARK) | F.upper(flag).isin(*V.COMBO_WORDS)


def is_cancelled(c: Column | str) -> Column:
    status = F.trim(F.coalesce(col(c), F.lit("")))
    return (status != "") & ~status.isin(*V.NOT_CANCELLED)


def row_payload(df: DataFrame) -> Column:
    """The whole source row as JSON text."""
    return F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]))


def name_uuid(c: Column | str) -> Column:
    """Version-5 UUID in the URL namespace, computed natively from SHA-1."""
    digest = F.sha1(F.concat(F.unhex(F.lit(V.URL_NAMESPACE_HEX)), F.encode(col(c), "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )


def plural_stem(c: Column | str) -> Column:
    word = col(c)
    size = F.length(word)
    return (
        F.when(size <= 3, word)
        .when(word.endswith("IES"), F.concat(F.substr(word, F.lit(1), size - 3), F.lit("Y")))
        .when(word.rlike("[SXZ]ES$"), F.substr(word, F.lit(1), size - 2))
        .when(word.rlike("[^S]S$"), F.substr(word, F.lit(1), size - 1))
        .otherwise(word)
    )


def words(c: Column | str, min_chars: int = 2) -> Column:
    """Space-separated words of at least ``min_chars`` characters, repeats kept."""
    return F.filter(F.split(F.coalesce(col(c), F.lit("")), " "), lambda w: F.length(w) >= min_chars)


def word_stems(c: Column | str, min_chars: int = 2) -> Column:
    return F.array_distinct(F.transform(words(c, min_chars), plural_stem))


def has_cjk(c: Column | str) -> Column:
    return col(c).rlike(r"[一-鿿]")


def extract_cjk(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(col(c), r"[^一-鿿]+", " "))


def normalize_cjk(c: Column | str, extended: bool = True) -> Column:
    if extended:
        return F.translate(col(c), V.CJK_SIMPLIFIED, V.CJK_TRADITIONAL)
    return F.translate(col(c), V.CJK_SIMPLIFIED_SHORT, V.CJK_TRADITIONAL_SHORT)


def one_char_deletions(c: Column | str) -> Column:
    """The text and every form of it with one character left out."""
    text = col(c)
    cut = F.transform(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)),
    )
    return F.array_distinct(F.concat(F.array(text), cut))


def cjk_near_match(segment: Column | str, text: Column | str) -> Column:
    """Does ``text`` contain ``segment`` with at most one character missing?"""
    return F.exists(one_char_deletions(segment), lambda d: F.contains(col(text), d))


def language_tag(c: Column | str) -> Column:
    cjk, latin = has_cjk(c), col(c).rlike("[A-Za-z]")
    return F.when(cjk & latin, "mixed").when(cjk, "zh").otherwise("en")


def percent_text(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.format_string("%.2f%%", part * 100.0 / whole)).otherwise(F.lit("0.00%"))


def paren_slice(c: Column | str) -> Column:
    """Text between the first '(' and the first ')', if that comes later."""
    text = F.coalesce(col(c), F.lit(""))
    start, end = F.instr(text, "("), F.instr(text, ")")
    return F.when((start > 0) & (end > start), F.substr(text, start + 1, end - start - 1))


def source_list(c: Column | str) -> Column:
    """Sorted distinct ';'-separated sources, or null."""
    return F.nullif(F.array_join(F.array_sort(F.array_distinct(split_clean(c, ";"))), ";"), F.lit(""))


def severity_name(c: Column | str, strict: bool = True) -> Column:
    name = F.lower(F.trim(F.coalesce(col(c), F.lit(""))))
    known = name.isin(*V.SEVERITY_RANK)
    if not strict:
        return F.when(known, name)
    message = F.concat(F.lit("unsupported severity: "), name)
    return F.when(known, name).otherwise(F.raise_error(message).cast("string"))


def severity_rank(c: Column | str) -> Column:
    return reduce(
        lambda acc, item: acc.when(col(c) == item[0], item[1]),
        V.SEVERITY_RANK.items(),
        F.when(F.lit(False), 0),
    ).otherwise(0)


def parse_int(c: Column | str) -> Column:
    return F.nullif(F.trim(col(c).cast("string")), F.lit("")).cast("int")


def response_json_text(c: Column | str) -> Column:
    """Repair a stored model response: fences, think tags and line breaks removed."""
    text = F.regexp_replace(col(c), r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"(?s)^```(?:json)?\s*\n?(.*?)\n?```$", "$1")
    text = F.regexp_replace(text, r"^\s+|\s+$", "")
    text = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    text = F.regexp_replace(text, r"(?s)<think>.*?\{", "{")
    return F.regexp_replace(text, r"\r\n|\n|\r", " ")


def parse_response(c: Column | str, schema: str) -> Column:
    return F.from_json(response_json_text(c), schema, {"mode": "PERMISSIVE"})
