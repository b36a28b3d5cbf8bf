"""Layout operators against slow plain models on random pages."""

import random
from statistics import median

import pytest

from medlink.catalog import load
from medlink.operators import layout as L

FRAME = "page_id long, element_idx long, text string, x double, y double, width double, height double"


def random_pages(seed, pages=40, size=25):
    rng = random.Random(seed)
    rows = []
    for p in range(pages):
        for i in range(rng.randint(1, size)):
            text = rng.choice(["word a", "吸入 x", "5 mg", "Medication Foo 5 mg", "用法", "*", "(note)", "Bar", "3 盒"])
            rows.append((p, i, text, float(rng.randint(0, 300)), float(rng.randint(0, 160)), float(rng.choice([20, 45, 90])), float(rng.choice([8, 12, 45]))))
    return rows


def by_page(rows):
    pages = {}
    for r in rows:
        pages.setdefault(r[0], []).append(r)
    return pages


def ordered(rows, tolerance):
    rows = sorted(rows, key=lambda r: r[4])
    out, anchor = [], None
    for r in rows:
        if anchor is None or r[4] - anchor > tolerance:
            anchor = r[4]
        out.append((anchor, r[3], r[1], r))
    return [r for *_, r in sorted(out, key=lambda t: t[:3])]


def test_reading_order(spark):
    rows = random_pages(3)
    got = L.reading_order(spark.createDataFrame(rows, FRAME)).collect()
    seen = {(r["page_id"], r["element_idx"]): r["reading_no"] for r in got}
    for page, items in by_page(rows).items():
        assert [seen[page, r[1]] for r in ordered(items, 10)] == list(range(1, len(items) + 1))


def test_banded_numbering_equals_plain(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(random_pages(4), FRAME)
    plain = L.reading_order(df).select("page_id", "element_idx", "reading_no")
    banded = L.reading_order(df, strips=F.floor(F.col("row_at") / 20)).select("page_id", "element_idx", "reading_no")
    assert plain.exceptAll(banded).count() == 0 and banded.exceptAll(plain).count() == 0


def test_rows_by_running_mean(spark):
    rows = random_pages(5)
    schema = "page_id long, element_idx long, text string, x1 double, y1 double, x2 double, y2 double, page_width int"
    boxes = [(p, i, t, x, y, x + w, y + h, 600) for p, i, t, x, y, w, h in rows]
    got = {(r["page_id"], r["element_idx"]): r["row_at"] for r in L.layout_rows(spark.createDataFrame(boxes, schema)).collect()}
    for page, items in by_page(boxes).items():
        kept = [b for b in items if (page, b[1]) in got]
        tolerance = 0.6 * median(b[6] - b[4] for b in kept)
        row, first = [], None
        for b in sorted(kept, key=lambda b: (b[4] + b[6]) / 2):
            centre = (b[4] + b[6]) / 2
            if not row or abs(centre - sum(row) / len(row)) > tolerance + 1e-9:
                row, first = [], centre
            row.append(centre)
            assert got[page, b[1]] == first


def test_layout_text_columns(spark):
    schema = "page_id long, element_idx long, text string, x1 double, y1 double, x2 double, y2 double, page_width int"
    rows = [(1, 0, "a", 0.0, 0.0, 10.0, 10.0, 800), (1, 1, "b", 40.0, 1.0, 50.0, 11.0, 800), (1, 2, "c", 110.0, 0.0, 120.0, 10.0, 800), (1, 3, "d", 0.0, 190.0, 9.0, 200.0, 800)]
    got = [r["text"] for r in L.layout_text(spark.createDataFrame(rows, schema)).orderBy("row_no").collect()]
    assert got == ["a b | c", "d"]


def merged_boxes(rows):
    codes = [r for r in rows if len(r[2].strip()) <= 2 and r[5] >= 40 and r[6] >= 40 and 0.7 <= r[5] / r[6] <= 1.4]
    out = []
    for r in ordered([r for r in rows if r not in codes], 1):
        _, _, text, x, y, w, h = r
        if out:
            t, a, b, c, d = out[-1]
            between = any(q[3] > c and q[3] + q[5] < x and min(q[4] + q[6], d) - max(q[4], b) > 0 for q in codes)
            level = abs((y + h / 2) - (b + d) / 2) <= 10
            if level and x - c <= (300 if between else 80):
                out[-1] = (t + " " + text, min(a, x), min(b, y), max(c, x + w), max(d, y + h))
                continue
        out.append((text, x, y, x + w, y + h))
    boxes = [(t, a, b, c - a, d - b) for t, a, b, c, d in out]
    return sorted(boxes + [(r[2], r[3], r[4], r[5], r[6]) for r in codes])


@pytest.mark.parametrize("seed", [6, 7])
def test_merge_adjacent(spark, seed):
    rows = random_pages(seed)
    got = {}
    for r in L.merge_adjacent(spark.createDataFrame(rows, FRAME)).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["x"], r["y"], r["width"], r["height"]))
    for page, items in by_page(rows).items():
        assert sorted(got[page]) == merged_boxes(items)


def test_merge_gaps(spark):
    def merge(gap):
        rows = [(1, 0, "aa", 0.0, 0.0, 20.0, 10.0), (1, 1, "bb", 20.0 + gap, 0.0, 20.0, 10.0)]
        return L.merge_adjacent(spark.createDataFrame(rows, FRAME)).count()

    assert merge(80.0) == 1 and merge(81.0) == 2


def test_sections(spark):
    rows = [
        (1, 0, "藥名", 0.0, 0.0, 40.0, 10.0), (1, 1, "Aspirin 100 mg", 0.0, 20.0, 90.0, 10.0), (1, 2, "3 盒", 0.0, 32.0, 20.0, 10.0),
        (1, 3, "用法", 0.0, 50.0, 40.0, 10.0), (1, 4, "飯後", 0.0, 70.0, 40.0, 10.0), (2, 0, "alone", 0.0, 0.0, 9.0, 9.0),
    ]
    got = {(r["page_id"], r["element_idx"]): r["section"] for r in L.assign_sections(spark.createDataFrame(rows, FRAME)).collect()}
    assert got == {(1, 1): "medication", (1, 2): "unassigned", (1, 4): "instruction", (2, 0): "unassigned"}


def test_groups_and_columns(spark):
    rows = [
        (1, 0, "Spiriva", 100.0, 0.0, 80.0, 10.0), (1, 1, "60 puff", 100.0, 14.0, 60.0, 10.0), (1, 2, "Other", 100.0, 80.0, 60.0, 10.0),
        (1, 3, "Medication Lipitor", 10.0, 80.0, 60.0, 10.0), (1, 4, "2盒", 10.0, 100.0, 20.0, 10.0),
    ]
    got = sorted(r["text"] for r in L.grouped_items(spark.createDataFrame(rows, FRAME)).collect())
    assert got == ["Other Lipitor", "Spiriva 60 puff"]


def test_dose_split_over_two_lines_completes_a_group(spark):
    rows = [(1, 0, "Spiriva 5", 100.0, 0.0, 80.0, 10.0), (1, 1, "mg 吸入", 100.0, 14.0, 60.0, 10.0), (1, 2, "*吸入", 100.0, 28.0, 60.0, 10.0)]
    got = sorted(r["text"] for r in L.grouped_items(spark.createDataFrame(rows, FRAME)).collect())
    assert got == ["*吸入", "Spiriva 5 mg 吸入"]


def test_steps_read_twice_are_written_once(spark, monkeypatch):
    """Groups and cut lines were worked out again for each of their two readers; line texts for each test of a filter."""
    rows, real, written = [(1, 1, "Medication Abc 5 mg", 10.0, 10.0, 50.0, 10.0), (1, 2, "5 mg", 10.0, 22.0, 50.0, 10.0)], L.checkpointed, []
    monkeypatch.setattr(L, "checkpointed", lambda df: written.append(df.columns) or real(df))
    lines = spark.createDataFrame(rows, FRAME)
    assert [r["text"] for r in L.grouped_items(lines).collect()] == ["Abc 5 mg 5 mg"]
    assert len(written) == 1 and "group_no" in written[0]
    L.merge_adjacent(lines)
    assert len(written) == 2 and "_stretch" in written[1]
    plan = L.group_lines(lines)._jdf.queryExecution().optimizedPlan().toString()
    assert not [p for p in plan.split("\n") if p.strip(" :+-").startswith("Filter") and "藥品查詢" in p]


def test_lines_are_tagged_once_for_all_readers_of_sections(spark):
    """Anchors, bands, body and bottoms read the tags; each reader worked out the patterns of every line again."""
    lines = spark.createDataFrame(
        [(1, 0, "用法", 0, 0, 50, 10), (1, 1, "take one", 5, 20, 50, 10)],
        "page_id long, element_idx int, text string, x int, y int, width int, height int",
    )
    out = L.assign_sections(lines)
    assert "^藥名" not in out._jdf.queryExecution().executedPlan().toString()
    assert [(r["element_idx"], r["section"]) for r in out.collect()] == [(1, "instruction")]


def test_pages_are_merged_in_one_shuffle_with_nothing_written(spark, monkeypatch):
    """Lines of all pages were written and shuffled several times, which filled the disk."""
    real, written = L.checkpointed, []
    monkeypatch.setattr(L, "checkpointed", lambda df: written.append(df.count()) or real(df))
    merged = load()[0]["line_merge"](spark, "/root/testdata/sf0.001")
    plan = merged._jdf.queryExecution().executedPlan().toString().splitlines()
    of_all_pages = [line for line in plan if line.startswith("   :")]  # the other side of the union has the large pages, of which there are none
    assert len([line for line in of_all_pages if "Exchange " in line]) == 1 and sum(written) == 0


@pytest.mark.parametrize("seed", [8, 9])
def test_large_pages_are_merged_as_others(spark, monkeypatch, seed):
    rows, real = random_pages(seed, 30, 60), L.hot_keys
    monkeypatch.setattr(L, "hot_keys", lambda df, keys: real(df, keys, 30))  # about half of the pages
    got = {}
    for r in L.merge_adjacent(spark.createDataFrame(rows, FRAME)).collect():
        got.setdefault(r["page_id"], []).append((r["text"], r["x"], r["y"], r["width"], r["height"]))
    assert {p: sorted(boxes) for p, boxes in got.items()} == {p: merged_boxes(items) for p, items in by_page(rows).items()}


def test_merge_of_lines_without_place_or_text(spark):
    """A null side was an error; as in the SQL such a line is a box of its own, the last of its page if it has no y."""
    rows = [(1, 0, "a", 0.0, 0.0, 20.0, 10.0), (1, 1, "b", None, 0.0, 20.0, 10.0), (1, 2, "c", 30.0, None, 20.0, 10.0), (1, 3, "d", 30.0, 1.0, 20.0, 10.0), (1, 4, None, 60.0, 1.0, 5.0, 5.0), (2, 0, None, 0.0, 0.0, 5.0, 5.0)]
    got = sorted(map(str, ((r["page_id"], r["element_idx"], r["text"], r["x"], r["y"], r["width"], r["height"]) for r in L.merge_adjacent(spark.createDataFrame(rows, FRAME)).collect())))
    assert got == sorted(map(str, [
        (1, 1, "a d", 0.0, 0.0, 65.0, 11.0), (1, 4, "b", None, 0.0, None, 10.0), (1, 5, "c", 30.0, None, 20.0, None), (2, 1, None, 0.0, 0.0, 5.0, 5.0),
    ]))


def test_hot_keys_are_found_by_their_hash_first(spark, monkeypatch):
    from medlink.operators import keyed as K

    rows = spark.createDataFrame([(k,) for k in [1] * 5 + [2] * 5 + [3, 4, None, None]], "k int")
    for hashes in (1, 7, 65_536):
        monkeypatch.setattr(K, "HASHES", hashes)
        assert sorted(r["k"] for r in K.hot_keys(rows, ["k"], 4).collect()) == [1, 2]
        assert K.hot_keys(rows, ["k"], 5) is None
    assert K.hot_band(rows, ["k"], rows["k"], 4) is not None and K.hot_band(rows, ["k"], rows["k"], 5) is None
