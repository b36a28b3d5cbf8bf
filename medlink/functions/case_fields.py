"""Field extraction from the raw text of one case (row-local, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V
from medlink.functions.text import col, let

LOOK_AHEAD = 3


def text_lines(c: Column | str) -> Column:
    return F.split(F.coalesce(col(c), F.lit("")), r"\r?\n")


def _first(items: Column) -> Column:
    return F.get(items, F.lit(0))


def _some(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def after_keyword(line: Column, keywords: tuple[str, ...]) -> Column:
    """What follows the first keyword that has something after it."""
    lower = F.lower(line)
    found = []
    for word in keywords:
        at = F.instr(lower, word)
        rest = F.substr(line, at + len(word))
        rest = F.trim(F.regexp_replace(rest, r"^[:：]\s*", ""))
        found.append(F.when(at > 0, _some(rest)))
    return F.coalesce(*found)


def section_values(lines: Column, keywords: tuple[str, ...]) -> Column:
    trimmed = F.filter(F.transform(lines, lambda x: F.trim(x)), lambda x: x != "")
    return F.filter(F.transform(trimmed, lambda x: after_keyword(x, keywords)), lambda x: x.isNotNull())


def iso_date(c: Column | str) -> Column:
    """Leading yyyy/mm/dd, yyyy-mm-dd or yyyy.mm.dd rewritten with dashes."""
    shape = r"^(\d{4})([/.-])(\d{2})\2(\d{2})"
    text = col(c)
    parts = [F.regexp_extract(text, shape, group) for group in (1, 3, 4)]
    return F.when(text.rlike(shape), F.concat_ws("-", *parts))


def name_token(c: Column | str) -> Column:
    """Masked CJK name, masked Latin name, or a 2-4 character CJK run."""
    text = col(c)
    return F.coalesce(
        *[
            _some(F.regexp_extract(text, pattern, 0))
            for pattern in (r"[一-鿿]O{2,}", r"[A-Z][a-z]+O{2,}", r"[一-鿿]{2,4}")
        ]
    )


def is_section_header(c: Column | str) -> Column:
    return F.trim(col(c)).rlike(V.SECTION_HEADER_START)


def is_header_only(c: Column | str) -> Column:
    return F.lower(F.trim(col(c))).isin(*V.SECTION_HEADERS)


def _following(lines: Column, is_label) -> Column:
    """For each label line the (at most three) lines after it, as an array of arrays."""
    after = F.transform(lines, lambda x, i: F.when(is_label(x), F.slice(lines, i + 2, LOOK_AHEAD)))
    return F.filter(after, lambda x: x.isNotNull())


def _name_after_label(lines: Column, is_label) -> Column:
    near = F.transform(F.flatten(_following(lines, is_label)), lambda x: F.trim(x))
    usable = F.filter(near, lambda x: (x != "") & ~F.lower(x).isin(*V.NAME_LABELS))
    return _first(F.filter(F.transform(usable, name_token), lambda x: x.isNotNull()))


def physician_name(text: Column, lines: Column) -> Column:
    inline = F.regexp_extract(text, r"處方醫師[^\S\n\r]*[:：]?[^\S\n\r]*([^\n\r]+)", 1)
    label = lambda x: F.contains(x, F.lit("處方醫師")) | F.contains(F.lower(x), F.lit("physician"))
    return F.coalesce(name_token(F.trim(inline)), _name_after_label(lines, label))


def pharmacist_name(text: Column, lines: Column) -> Column:
    inline = F.regexp_extract(text, r"[調詞][劑制]?[藥樂]師[^\S\n\r]*[:：]?[^\S\n\r]*([^\n\r]+)", 1)
    same_line = _first(section_values(lines, ("調劑藥師", "pharmacist")))
    label = lambda x: (F.lower(F.trim(x)) == "pharmacist") | F.contains(x, F.lit("藥師"))
    return F.coalesce(name_token(F.trim(inline)), name_token(same_line), _name_after_label(lines, label))


def pharmacy_name(lines: Column) -> Column:
    place = "(?:醫院|診所|藥局|藥房)"
    names = F.transform(
        F.transform(lines, lambda x: F.trim(x)),
        lambda x: F.when(
            x.rlike(place) & ~x.startswith("地址") & ~F.contains(x, F.lit("藥師")),
            _some(F.regexp_extract(x, f"[一-鿿A-Za-z0-9]{{2,12}}{place}", 0)),
        ),
    )
    return _first(F.filter(names, lambda x: x.isNotNull()))


def dispensing_date(lines: Column) -> Column:
    same_line = iso_date(F.trim(_first(section_values(lines, ("調劑日期", "dispensing date")))))
    label = lambda x: F.contains(x, F.lit("調劑日期")) | F.contains(F.lower(x), F.lit("dispensing date"))
    nearest = F.transform(
        _following(lines, label),
        lambda near: iso_date(
            _first(F.filter(F.transform(near, lambda x: F.trim(x)), lambda x: x != ""))
        ),
    )
    return F.coalesce(same_line, _first(F.filter(nearest, lambda x: x.isNotNull())))


def patient_sex(text: Column, lines: Column) -> Column:
    name_line = F.regexp_extract(text, r"姓名\s*[:：].+", 0)
    inline = F.when(name_line.contains("男"), "M").when(name_line.contains("女"), "F")
    header_at = F.array_position(F.transform(lines, is_section_header), True)
    before = F.when(header_at > 0, header_at - 1).otherwise(F.lit(30)).cast("int")
    head = F.transform(F.slice(lines, F.lit(1), F.least(before, F.size(lines))), lambda x: F.trim(x))
    male, female = F.array_contains(head, "男"), F.array_contains(head, "女")
    alone = F.when(male & ~female, "M").when(female & ~male, "F")
    return F.coalesce(inline, alone)


def case_fields(c: Column | str) -> Column:
    """All fields of one case text as a struct; the text is split into lines once."""
    text = F.coalesce(col(c), F.lit(""))
    return let(F.struct(text.alias("text"), text_lines(c).alias("lines")), lambda s: _fields(s["text"], s["lines"]))


def _fields(text: Column, lines: Column) -> Column:
    directions = F.filter(section_values(lines, ("用法", "instruction")), lambda x: ~is_header_only(x))
    return F.struct(
        _some(F.array_join(directions, ", ")).alias("directions"),
        dispensing_date(lines).alias("dispensing_date"),
        section_values(lines, ("用途", "indications")).alias("indications"),
        _some(F.regexp_extract(text, r"姓名\s*[:：]\s*([一-鿿]+)", 1)).alias("patient_name"),
        patient_sex(text, lines).alias("patient_sex"),
        pharmacist_name(text, lines).alias("pharmacist_name"),
        physician_name(text, lines).alias("physician_name"),
        _some(F.trim(F.regexp_extract(text, r"地址\s*[:：]\s*([^\n\r]+)", 1))).alias("pharmacy_address"),
        pharmacy_name(lines).alias("pharmacy_name"),
        _some(
            F.regexp_replace(F.regexp_extract(text, r"[,，]?\s*總量\s*(\d+\s*[一-鿿]{1,2})", 1), r"\s+", "")
        ).alias("quantity"),
        section_values(lines, ("副作用", "side effects")).alias("side_effects"),
        section_values(lines, ("警語", "warnings&precautions", "warnings")).alias("warnings"),
    )


def response_fields(fields: Column) -> Column:
    """Case fields of a stored response: two keys dropped, three wrapped in arrays."""
    plain = (
        "patientName", "patientSex", "quantity", "directions", "pharmacyName", "pharmacyAddress",
        "pharmacistName", "physicianName", "dispensingDate", "prescriptionNo", "useBefore",
    )
    wrapped = ("indications", "warnings", "sideEffects")
    parts = [fields[name].alias(name) for name in plain]
    parts += [F.when(fields[name].isNotNull(), F.array(fields[name])).alias(name) for name in wrapped]
    return F.when(fields.isNotNull(), F.struct(*parts))


def instruction_lines(lines: Column | str) -> Column:
    return F.filter(col(lines), lambda x: ~F.lower(F.trim(x)).isin(*V.INSTRUCTION_HEADERS))


def first_line(c: Column | str) -> Column:
    """First non-blank line of a text, trimmed."""
    lines = F.filter(F.transform(text_lines(c), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(_first(lines), F.lit(""))
