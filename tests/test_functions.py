"""Golden values for column functions, and slow plain models for the folds."""

import datetime as dt
import random
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from medlink.functions import case_fields as K
from medlink.functions import fixed_values as V
from medlink.functions import ingredients as I
from medlink.functions import ocr_text as O
from medlink.functions import text as T


def lit(x):
    return F.lit(x).cast("string")


def test_normalizers(value):
    assert value(T.normalize_text(lit("  Acetaminophen (500mg)  "))) == "ACETAMINOPHEN 500MG"
    assert value(T.normalize_text(lit("a_b"))) == "A_B"
    assert value(T.normalize_text_sql(lit("a_b"))) == "A B"
    assert value(T.normalize_text(lit(None))) == ""


def test_numbers_and_dates(value):
    assert value(T.parse_decimal(lit("1,234.50"))) == Decimal("1234.500000")
    assert value(T.parse_decimal(lit("-"))) is None
    for text, day in (
        ("2026-05-13", dt.date(2026, 5, 13)),
        ("20260513", dt.date(2026, 5, 13)),
        ("900401", dt.date(2001, 4, 1)),
        ("1130101", dt.date(2024, 1, 1)),
    ):
        assert value(T.parse_date(lit(text))) == day
    assert value(T.parse_date(lit(""))) is None
    assert value(T.parse_date(lit("soon"), strict=False)) is None
    with pytest.raises(Exception, match="unsupported date"):
        value(T.parse_date(lit("soon")))


def test_permit_token(value):
    assert value(T.permit_token(lit("https://x/q?licId=01000015"))) == "01000015"
    assert value(T.permit_token(lit("https://x/a/%E8%A1%9B%E7%BD%B2%E8%97%A5%E8%A3%BD%E5%AD%97%E7%AC%AC000015%E8%99%9F"))) == "衛署藥製字第000015號"
    assert value(T.permit_token(lit("plain"))) == "plain"
    assert value(T.permit_token(lit(" "))) is None


def test_stems_and_ids(value):
    for word, stem in (
        ("SENNOSIDES", "SENNOSIDE"), ("CITIES", "CITY"), ("BOXES", "BOX"), ("BUZZES", "BUZZ"),
        ("ASSESSES", "ASSESS"), ("GLASS", "GLASS"), ("MG", "MG"),
    ):
        assert value(T.plural_stem(lit(word))) == stem
    assert value(T.name_uuid(lit("WARFARIN SODIUM"))) == "85f17a1f-ce4f-56b1-8e93-da323b8e9767"


def test_cjk(value):
    assert len(V.CJK_SIMPLIFIED) == len(V.CJK_TRADITIONAL) == 81
    assert len(V.CJK_SIMPLIFIED_SHORT) == len(V.CJK_TRADITIONAL_SHORT) == 28
    assert value(T.cjk_near_match(lit("糖倍平"), lit("糖平膜衣錠"))) is True
    assert value(T.cjk_near_match(lit("止痛錠"), lit("糖平膜衣錠"))) is False
    assert [value(T.language_tag(lit(t))) for t in ("a藥", "藥", "1")] == ["mixed", "zh", "en"]


def test_compare_tokens(value):
    def tokens(text):
        return set(value(I.compare_tokens(lit(text))))

    assert tokens("CHLORPROMAZINE (HCL) 100 MG") == {"CHLORPROMAZINE", "CHLORPROMAZINE HCL"}
    assert tokens("METOCLOPRAMIDE (2HCL MONOHYDRATE) 5 MG") == {"METOCLOPRAMIDE", "METOCLOPRAMIDE 2HCL"}
    assert tokens("DL-METHIONINE") == {"METHIONINE"}
    assert tokens("SULPYRIN") == {"DIPYRONE"}
    assert value(I.strip_strength(lit("VITAMIN B12 100 MCG + VITAMIN D3 400 IU"))) == "VITAMIN B12 + VITAMIN D3"


def test_alias_collision():
    with pytest.raises(ValueError, match="belongs to both"):
        I.alias_lookup({"A": ["X"], "B": ["x"]})


def test_ocr_keys(value):
    assert value(O.ocr_spacing(lit("Respi mat 2. 5"))) == "respimat 2.5"
    assert value(O.strip_dosage_tail(lit("Aspirin 100mg tab"))) == "Aspirin "
    assert value(O.strip_dosage_tail(lit("x 50% y"))) == "x 50% y"


def test_quantity_only(value):
    for text in ("1盒", "2瓶", "3支", "1会", "1合", "1金"):
        assert value(O.is_quantity_only(lit(text))) is True
    assert value(O.is_quantity_only(lit("2 mg"))) is False


def joined(words):
    """Plain model of one left-to-right joining round over (word, gap) pairs."""
    out, i = [], 0

    def plain(w):
        return re.fullmatch("[A-Za-z]{2,}", w) and w.lower() not in V.MERGE_EXCLUDED

    while i < len(words):
        word, gap = words[i]
        if i + 1 < len(words):
            other = words[i + 1][0]
            if plain(word) and plain(other) and len(word + other) <= 20 and min(len(word), len(other)) < 5:
                out.append((word + other, words[i + 1][1]))
                i += 2
                continue
        out.append((word, gap))
        i += 1
    return out


def test_english_spacing_against_model(spark):
    assert "Medication 60puff" == spark.range(1).select(O.english_spacing(F.lit("Medi cation 60puff"))).first()[0]
    rng = random.Random(1)
    pool = ["ab", "cde", "mg", "long", "fives", "sixsix", "A1", "x", "Warning", "特", "verylongwordhere"]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "  ", " "]) for _ in range(rng.randint(1, 9))) for _ in range(200)]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(O.english_spacing("t")).collect()]
    for text, result in zip(texts, got, strict=True):
        pairs = re.findall(r"(\S+)(\s*)", text)
        for _ in range(3):
            pairs = joined(pairs)
        assert result == "".join(w + g for w, g in pairs)


def open_merge(lines):
    """Plain model: positions of source lines per merged line."""
    out, held = [], []
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        held.append((i, line.strip()))
        text = " ".join(t for _, t in held)
        if text[-1] in "&+" or text.count("(") > text.count(")"):
            continue
        out.append((text, held[0][0], i))
        held = []
    if held:
        out.append((" ".join(t for _, t in held), held[0][0], held[-1][0]))
    return out


def test_open_lines_against_model(spark):
    rng = random.Random(2)
    pool = ["Aspirin &", "Metformin", "x (a", "b)", "", "+", "c +", "d) e"]
    cases = [[rng.choice(pool) for _ in range(rng.randint(0, 8))] for _ in range(200)] + [["Aspirin &", "Metformin"]]
    df = spark.createDataFrame([(c,) for c in cases], "l array<string>")
    for case, row in zip(cases, df.select("l", O.merge_open_lines("l").alias("m")).collect(), strict=True):
        assert [(m["text"], m["first"], m["last"]) for m in row["m"]] == open_merge(case)


def test_item_lines(value):
    lines = F.array(*[F.lit(x) for x in ("Spiriva", "60puff", "Aspirin 100mg", "ASPIRIN 100MG", "Quantity 3", "12")])
    assert value(O.merge_item_lines(lines)) == ["Spiriva 60puff", "Aspirin 100mg"]
    assert value(O.pre_clean_line(lit("• l0O mg  paff,,"))) == "100 mg puff,"
    assert value(O.line_confidence(lit("Aspirin 100mg Tab (x) (Abc)"))) == 0.95


def test_case_fields(value):
    text = "姓名：王小明 男\n處方醫師\n林大明\n調劑日期 2024/01/02\n用法：飯後\n警語 小心\n副作用: 頭暈\n總量 12 顆\n仁愛藥局"
    got = value(K.case_fields(lit(text))).asDict()
    assert got["patient_name"] == "王小明" and got["patient_sex"] == "M"
    assert got["physician_name"] == "林大明" and got["dispensing_date"] == "2024-01-02"
    assert got["directions"] == "飯後" and got["warnings"] == ["小心"] and got["quantity"] == "12顆"
    assert got["pharmacy_name"] == "仁愛藥局"


def test_response_repair(value):
    for raw in ('```json\n{"k":"v\nw"}\n```', '<think>a {b}</think>{"k":"v w"}', '<think>open {"k":"v w"}'):
        assert value(T.parse_response(lit(raw), "k string"))["k"] == "v w"


def test_line_tests_equal_the_plain_patterns(spark):
    """Patterns are tried only where they can begin; before, every one was tried at every place of a line, some four times."""
    from medlink.functions.patterns import ascii_bounds

    assert ascii_bounds(r"\b\d+") == r"(?<![A-Za-z0-9_])\d+" and ascii_bounds(r"\b(mg|%)").startswith("(?:")
    word = "[A-Za-z0-9_]"
    plain = lambda p: p.replace(r"\b", f"(?:(?<!{word})(?={word})|(?<={word})(?!{word}))")
    bits = ["5 mg", "12mcg", "3%", "60 puff", "PUFFS", "Tab", "capsule", "錠", "口服", "use before", "Warning", "用法", "藥", "(Ab", ")", "02-2345-6789", "123456789", "123", "x", "_", "é", " ", "-", "\u212a", "m c g", "paff", "O1 mg", "\u0001"]
    pick = random.Random(5)
    rows = [("".join(pick.choice(bits) for _ in range(pick.randrange(7))),) for _ in range(3000)] + [(None,)]
    lines = spark.createDataFrame(rows, "l string")
    has = {n: F.col("l").rlike(plain(getattr(V, n))) for n in ("DOSAGE", "FORM", "PUFF", "PAREN_HINT", "PHONE_OR_CODE", "BOILERPLATE")}
    form = has["FORM"] | has["PUFF"]
    noise = has["PHONE_OR_CODE"] | has["BOILERPLATE"] | ((F.length("l") < 4) & ~has["DOSAGE"])
    letter = F.col("l").rlike("[A-Za-z]")
    keep = has["DOSAGE"] | form | has["PAREN_HINT"] | (letter & F.col("l").rlike(r"\d"))
    want = F.struct(has["DOSAGE"], form, has["PAREN_HINT"], noise, keep, ~noise & (letter | keep))
    one = F.struct(O.has_dosage("l"), O.has_form("l"), O.has_paren_hint("l"), O.is_hard_noise("l"), O.is_worth_keeping("l"), O.is_name_line("l"))
    for r in lines.select("l", want.alias("want"), O.line_tests("l").alias("got"), one.alias("one")).collect():
        assert tuple(r["want"]) == tuple(r["got"]) == tuple(r["one"]), r["l"]
