"""Clean-up and tests for recognised text lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V
from medlink.functions.patterns import ascii_bounds, unicode_bounds
from medlink.functions.text import col, let


def _squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def strip_dosage_tail(c: Column | str) -> Column:
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), V.TOTAL_TAIL, "")
    return F.regexp_replace(text, unicode_bounds(V.DOSE_TAIL), "")


def ocr_spacing(c: Column | str) -> Column:
    """Lower case, close up split decimals and split short words (three rounds)."""
    text = F.lower(_squeeze(F.coalesce(col(c), F.lit(""))))
    text = F.regexp_replace(text, V.SPACED_DECIMAL, "$1.$2")
    text = F.trim(F.regexp_replace(text, V.ORPHAN_NUMBER, " "))
    for _ in range(3):
        text = F.regexp_replace(text, unicode_bounds(V.SPLIT_WORD), "$1$2")
    return text


def line_key(c: Column | str) -> Column:
    return ocr_spacing(strip_dosage_tail(ocr_spacing(c)))


def name_key(c: Column | str) -> Column:
    return ocr_spacing(strip_dosage_tail(c))


def clean_head(c: Column | str) -> Column:
    """First half of the aggressive clean-up: leading Han run and parentheses removed."""
    text = F.regexp_replace(F.coalesce(col(c), F.lit("")), r"^\p{IsHan}+", "")
    return F.regexp_replace(text, r"\([^()]*\)", "")


def trailing_code(c: Column | str) -> Column:
    """Last word in capitals when it looks like a 2-4 character code after another word."""
    shape = r"\S.* ([A-Za-z0-9]{2,4})$"
    return F.upper(F.nullif(F.regexp_extract(F.trim(col(c)), shape, 1), F.lit("")))


def clean_tail(c: Column | str, drop_code: Column) -> Column:
    """Second half: drop the code if told to, split letter-digit runs, cut the dose."""
    text = col(c)
    code = F.length(trailing_code(c))
    kept = F.trim(F.substr(text, F.lit(1), F.greatest(F.length(text) - code - 1, F.lit(0))))
    text = F.when(drop_code, kept).otherwise(text)
    text = F.regexp_replace(text, r"([a-zA-Z])(\d)", "$1 $2")
    return _squeeze(F.regexp_replace(text, unicode_bounds(V.CLEAN_DOSE_TAIL), ""))


def english_spacing(c: Column | str) -> Column:
    """Join neighbouring Latin fragments, left to right, three rounds, then fixed repairs."""
    text = col(c)
    joined = text
    for _ in range(3):
        joined = let(joined, _join_fragments)
    text = F.when(text.rlike(r"[A-Za-z]{2}\s+[A-Za-z]{2}"), joined).otherwise(text)
    for pattern, replacement in V.OCR_WORD_FIXES:
        text = F.regexp_replace(text, pattern, replacement)
    return text


def _join_fragments(text: Column) -> Column:
    lead = F.regexp_extract(text, r"^\s*", 0)
    cells = F.transform(
        F.regexp_extract_all(text, F.lit(r"\S+\s*"), F.lit(0)),
        lambda x: F.struct(
            F.regexp_extract(x, r"^\S+", 0).alias("word"),
            F.regexp_extract(x, r"\s*$", 0).alias("space"),
        ),
    )

    def plain(word: Column) -> Column:
        return word.rlike("^[A-Za-z]{2,}$") & ~F.lower(word).isin(*V.MERGE_EXCLUDED)

    def step(state: Column, cell: Column) -> Column:
        held, word = state["word"], cell["word"]
        joins = (
            plain(held)
            & plain(word)
            & (F.length(held) + F.length(word) <= V.MERGE_MAX_CHARS)
            & ~((F.length(held) >= 5) & (F.length(word) >= 5))
        )
        joined = F.concat(state["done"], held, word, cell["space"])
        moved = F.concat(state["done"], held, state["space"])
        return F.when(
            joins,
            F.struct(joined.alias("done"), F.lit("").alias("word"), F.lit("").alias("space")),
        ).otherwise(F.struct(moved.alias("done"), word.alias("word"), cell["space"].alias("space")))

    start = F.struct(lead.alias("done"), F.lit("").alias("word"), F.lit("").alias("space"))
    return F.aggregate(cells, start, step, lambda s: F.concat(s["done"], s["word"], s["space"]))


def detection_form(c: Column | str) -> Column:
    return F.lower(english_spacing(c))


# --- free-text line clean-up and tests ----------------------------------------


def _fix_dose_digits(text: Column) -> Column:
    """O and l read as digits, only inside a number that stands before a unit."""
    dose = ascii_bounds(r"(?i)\b[0-9OIllo]+(?:\.[0-9OIllo]+)?\s*(?:mcg|mg|g|ml|iu|%)\b")
    return let(text, lambda t: F.when(t.rlike(dose) | F.contains(t, F.lit("\u0001")), _fix_doses(t, dose)).otherwise(t))


def _fix_doses(text: Column, dose: str) -> Column:
    pieces = F.split(F.regexp_replace(text, f"({dose})", "\u0001$1\u0001"), "\u0001")
    number = r"(?i)^[0-9OIllo]+(?:\.[0-9OIllo]+)?"

    def fix(piece: Column, index: Column) -> Column:
        head = F.regexp_extract(piece, number, 0)
        fixed = F.translate(head, "OoIil", "00111")
        swapped = F.concat(fixed, F.substr(piece, F.length(head) + 1))
        return F.when(index % 2 == 1, swapped).otherwise(piece)

    return F.array_join(F.transform(pieces, fix), "")


def pre_clean_line(c: Column | str) -> Column:
    text = F.regexp_replace(_squeeze(col(c)), r"^[*•·\-–—]+\s*", "")
    text = F.regexp_replace(text, r"([.,;:])[.,;:]+", "$1")
    text = F.regexp_replace(text, ascii_bounds(r"(?i)\bm\s*c\s*g\b"), "mcg")
    text = F.regexp_replace(text, ascii_bounds(r"(?i)\bpaff\b"), "puff")
    return _squeeze(_fix_dose_digits(text))


def _finds(line: Column, pattern: str, letters: str) -> Column:
    """Whether the pattern is found; its matches begin with one of the letters or with a Han sign, only there it is tried."""
    led = lambda first: line.rlike(f"(?=[{first}])(?:{ascii_bounds(pattern)})")
    return led(letters) | led("一-鿿")


def has_dosage(c: Column | str) -> Column:
    return col(c).rlike(r"\d") & col(c).rlike(ascii_bounds(V.DOSAGE))


def _has_puff(c: Column | str) -> Column:
    return col(c).rlike("(?i)puff") & col(c).rlike(ascii_bounds(V.PUFF))


def has_form(c: Column | str) -> Column:
    return _finds(col(c), V.FORM, "TtCcSsIiRr") | _has_puff(c)


def has_paren_hint(c: Column | str) -> Column:
    return col(c).rlike(V.PAREN_HINT)


def _is_code_or_boilerplate(c: Column | str) -> Column:
    line = col(c)
    code = line.rlike(r"\d{3}") & line.rlike(ascii_bounds(V.PHONE_OR_CODE))
    return code | _finds(line, V.BOILERPLATE, "PpQqDdWwSsIiAaUu")


def is_hard_noise(c: Column | str) -> Column:
    return _is_code_or_boilerplate(c) | ((F.length(col(c)) < 4) & ~has_dosage(c))


def is_worth_keeping(c: Column | str) -> Column:
    line = col(c)
    mixed = line.rlike("[A-Za-z]") & line.rlike(r"\d")
    return has_dosage(line) | has_form(line) | has_paren_hint(line) | mixed


def line_tests(c: Column | str) -> Column:
    """has_dosage, has_form, has_hint, hard_noise, keep, name_line of a line as a struct; each pattern is searched once."""
    line = col(c)
    found = F.struct(
        has_dosage(line).alias("dosage"), has_form(line).alias("form"), has_paren_hint(line).alias("hint"),
        _is_code_or_boilerplate(line).alias("noise"), line.rlike("[A-Za-z]").alias("letter"),
        line.rlike(r"\d").alias("digit"), (F.length(line) < 4).alias("short"),
    )

    def tests(s: Column) -> Column:
        noise = s["noise"] | (s["short"] & ~s["dosage"])
        keep = s["dosage"] | s["form"] | s["hint"] | (s["letter"] & s["digit"])
        return F.struct(
            s["dosage"].alias("has_dosage"), s["form"].alias("has_form"), s["hint"].alias("has_hint"),
            noise.alias("hard_noise"), keep.alias("keep"), (~noise & (s["letter"] | keep)).alias("name_line"),
        )

    return let(found, tests)


def is_name_line(c: Column | str) -> Column:
    return ~is_hard_noise(c) & (col(c).rlike("[A-Za-z]") | is_worth_keeping(c))


def continues_name(c: Column | str) -> Column:
    return has_dosage(c) | has_form(c) | has_paren_hint(c)


def is_open_name(c: Column | str) -> Column:
    return is_name_line(c) & ~has_dosage(c) & ~has_paren_hint(c)


def line_confidence(c: Column | str) -> Column:
    line = col(c)

    def points(test: Column, value: int) -> Column:
        return F.when(test, value).otherwise(0)

    hundredths = (
        F.lit(50)
        + points(has_dosage(line), 20)
        + points(has_form(line), 20)
        + points(_has_puff(line) & ~has_dosage(line), 20)
        + points(has_paren_hint(line), 10)
    )
    return F.least(hundredths, F.lit(95)) / F.lit(100.0)


# --- grouped-line helpers -----------------------------------------------------


def group_text(c: Column | str) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(col(c)), ascii_bounds(r"(?i)\bpaff\b"), "puff"), r"\s+", " ")


def strip_inline_header(c: Column | str) -> Column:
    def strip(text: Column) -> Column:
        english = F.trim(F.regexp_extract(text, r"(?i)^(medication)\s+(.+)$", 2))
        chinese = F.trim(F.regexp_extract(text, r"^(藥名)\s*(.+)$", 2))
        return F.when(english != "", english).when(chinese != "", chinese).otherwise(text)

    return let(group_text(c), strip)


def is_inline_header(c: Column | str) -> Column:
    return group_text(c).rlike(r"(?i)^(medication|藥名)\s+.+")


def strip_trailing_quantity(c: Column | str) -> Column:
    text = F.regexp_replace(F.trim(col(c)), V.TOTAL_UNIT, "")
    text = F.regexp_replace(text, V.TOTAL_ANY, "")
    text = F.regexp_replace(text, V.TOTAL_ENGLISH, "")
    return F.regexp_replace(F.trim(text), r"\s{2,}", " ")


def is_quantity_only(c: Column | str) -> Column:
    return F.regexp_replace(col(c), r"\s+", "").rlike(V.QUANTITY_ONLY)


def is_label_noise(c: Column | str) -> Column:
    def noise(text: Column) -> Column:
        rest = F.regexp_replace(F.regexp_replace(F.lower(text), V.LABEL_WORDS, ""), r"[:：,，.\-()/\s]", "")
        # nothing can be left only where a label word comes first
        led = F.lower(text).rlike(rf"^[:：,，.\-()/\s]*(?:$|{V.LABEL_WORDS})")
        return text.rlike(ascii_bounds(V.META_LINE)) | text.rlike(ascii_bounds(V.META_PREFIX)) | (led & (rest == ""))

    return let(strip_inline_header(c), noise)


def starts_new_item(c: Column | str) -> Column:
    return col(c).rlike(V.HEADER) | col(c).rlike(r"^[*•·\-–—]")


def has_inline_detail(c: Column | str) -> Column:
    line = col(c)
    return (
        line.rlike(ascii_bounds(V.DOSAGE)) | line.rlike(ascii_bounds(V.CONTAINER_WORD)) | line.rlike(V.QUANTIFIER) | F.contains(line, F.lit("("))
    )


def is_continuation(c: Column | str) -> Column:
    def test(text: Column) -> Column:
        size = F.length(text)
        cjk = size - F.length(F.regexp_replace(text, r"[一-鿿]", ""))
        mostly_cjk = (cjk / F.greatest(size, F.lit(1)) >= 0.5) & (size <= 25)
        return (
            text.startswith("(")
            | text.rlike(ascii_bounds(V.DOSAGE))
            | text.rlike(ascii_bounds(V.CONTAINER_WORD))
            | ((size <= 10) & text.rlike(V.QUANTIFIER))
            | mostly_cjk
            | text.rlike(V.CJK_FORM)
        )

    return let(group_text(c), test)


def strip_non_medication(c: Column | str) -> Column:
    text = col(c)
    for pattern in V.NON_MEDICATION_TEXT:
        text = F.regexp_replace(text, pattern, "")
    return F.trim(text)


def is_usable_other_line(c: Column | str) -> Column:
    line = F.trim(col(c))
    starts = F.lit(False)
    for word in V.NON_MEDICATION_STARTS:
        starts = starts | line.startswith(word)
    sized = (line != "") & (F.length(line) < V.OTHER_LINE_MAX_CHARS)
    return sized & ~starts & (line.rlike("[A-Za-z]{4,}") | line.rlike(V.OTHER_LINE_DOSE))


def merge_item_lines(lines: Column | str) -> Column:
    """Cleaned lines of one text; an open name takes the line after it when that continues it.

    The fold keeps one held line, so a line is used at most once.
    """
    cleaned = F.filter(F.transform(col(lines), pre_clean_line), lambda x: (x != "") & ~is_hard_noise(x))
    # no hard noise is left, so a name line is one with a letter or worth keeping; each pattern is searched once
    found = lambda x: F.struct(
        x.alias("text"), has_dosage(x).alias("dosage"), has_form(x).alias("form"), has_paren_hint(x).alias("hint"), x.rlike("[A-Za-z]").alias("letter")
    )
    cells = F.transform(
        F.transform(cleaned, found),
        lambda s: F.struct(
            s["text"].alias("text"),
            ((s["letter"] | s["form"]) & ~s["dosage"] & ~s["hint"]).alias("open"),
            (s["dosage"] | s["form"] | s["hint"]).alias("more"),
        ),
    )

    def step(state: Column, cell: Column) -> Column:
        held = state["held"]
        joins = held.isNotNull() & cell["more"] & (F.lower(held) != F.lower(cell["text"]))
        joined = _squeeze(F.concat_ws(" ", held, cell["text"]))
        flushed = F.when(held.isNotNull(), F.concat(state["out"], F.array(held))).otherwise(state["out"])
        none = F.lit(None).cast("string")
        return (
            F.when(joins, F.struct(F.concat(state["out"], F.array(joined)).alias("out"), none.alias("held")))
            .when(cell["open"], F.struct(flushed.alias("out"), cell["text"].alias("held")))
            .otherwise(F.struct(F.concat(flushed, F.array(cell["text"])).alias("out"), none.alias("held")))
        )

    start = F.struct(
        F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("held")
    )
    finish = lambda s: F.when(s["held"].isNotNull(), F.concat(s["out"], F.array(s["held"]))).otherwise(s["out"])
    return distinct_ignoring_case(F.aggregate(cells, start, step, finish))


def distinct_ignoring_case(lines: Column) -> Column:
    """First spelling of each line, order kept (sort by spelling, keep run heads, sort back)."""
    cells = F.transform(lines, lambda x, i: F.struct(F.lower(x).alias("key"), i.alias("pos"), x.alias("text")))

    def heads(ordered: Column) -> Column:
        first = F.filter(
            ordered, lambda c, i: (i == 0) | (c["key"] != F.get(ordered, F.greatest(i - 1, F.lit(0)))["key"])
        )
        back = F.array_sort(F.transform(first, lambda c: F.struct(c["pos"].alias("pos"), c["text"].alias("text"))))
        return F.transform(back, lambda c: c["text"])

    return let(F.array_sort(cells), heads)


def merge_open_lines(lines: Column | str) -> Column:
    """Join a line with the ones after it while it ends in & or + or has an open parenthesis.

    Returns structs (text, first, last): the merged text and the 0-based source positions.
    """
    cells = F.transform(col(lines), lambda x, i: F.struct(F.trim(x).alias("text"), i.alias("pos")))
    cells = F.filter(cells, lambda c: c["text"] != "")
    span = "struct<text:string,first:int,last:int>"

    def step(state: Column, cell: Column) -> Column:
        text = F.concat_ws(" ", state["text"], cell["text"])
        first = F.coalesce(state["first"], cell["pos"])
        opens = F.length(F.regexp_replace(text, r"[^(]", ""))
        closes = F.length(F.regexp_replace(text, r"[^)]", ""))
        open_ended = F.right(text, F.lit(1)).isin("&", "+") | (opens > closes)
        whole = F.struct(text.alias("text"), first.alias("first"), cell["pos"].alias("last")).cast(span)
        return F.when(
            open_ended,
            F.struct(
                state["out"].alias("out"), text.alias("text"), first.alias("first"), cell["pos"].alias("last")
            ),
        ).otherwise(
            F.struct(
                F.concat(state["out"], F.array(whole)).alias("out"),
                F.lit(None).cast("string").alias("text"),
                F.lit(None).cast("int").alias("first"),
                F.lit(None).cast("int").alias("last"),
            )
        )

    start = F.struct(
        F.array().cast(f"array<{span}>").alias("out"),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("int").alias("first"),
        F.lit(None).cast("int").alias("last"),
    )

    def finish(state: Column) -> Column:
        rest = F.struct(state["text"].alias("text"), state["first"].alias("first"), state["last"].alias("last"))
        return F.when(
            state["text"].isNotNull(), F.concat(state["out"], F.array(rest.cast(span)))
        ).otherwise(state["out"])

    return F.aggregate(cells, start, step, finish)
