"""Page layout from recognised elements.

Rows of a page are found on the *distinct* positions of the page, not on its
elements: ``groupBy(page, position)`` combines on the map side, a row can only
break where neighbouring positions lie further apart than the tolerance, and the
short running fold happens inside each such stretch.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from medlink.functions import fixed_values as V
from medlink.functions import ocr_text as O
from medlink.functions.patterns import ascii_bounds
from medlink.functions.text import col, let
from medlink.operators.keyed import checkpointed, hot_band, hot_keys, positions, running

PAGE = ("page_id",)
BAND_PIXELS = 512
#: Lines at most so far below the first line of a row belong to it when boxes are joined.
MERGE_ROW_PIXELS = 1.0
#: Matrix codes of a page are looked up by bands of this height.
CODE_BAND = 64


def _strips(lines: DataFrame, keys: Sequence[str]) -> Column | None:
    """Horizontal strips if some page is too large for one task, else None."""
    return hot_band(lines, keys, F.floor(F.col("row_at") / BAND_PIXELS).cast("int"))


# --- boxes --------------------------------------------------------------------


def confident(elements: DataFrame, minimum: float = V.ELEMENT_MIN_CONFIDENCE, contains: str = "") -> DataFrame:
    kept = elements.where(F.col("confidence") >= minimum)
    return kept.where(F.contains(F.lower("text"), F.lit(contains.lower()))) if contains else kept


def polygon_box(points: Column | str) -> dict[str, Column]:
    """x1, y1, x2, y2 of an array of (x, y) structs."""
    xs, ys = F.transform(col(points), lambda p: p["x"]), F.transform(col(points), lambda p: p["y"])
    return {"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys)}


def clip_boxes(elements: DataFrame, width: str = "page_width", height: str = "page_height") -> DataFrame:
    """Clip boxes to the page and drop the empty ones."""
    clipped = elements.withColumns(
        {
            "x1": F.greatest(F.col("x1"), F.lit(0)),
            "y1": F.greatest(F.col("y1"), F.lit(0)),
            "x2": F.least(F.col("x2"), F.col(width)),
            "y2": F.least(F.col("y2"), F.col(height)),
        }
    )
    return clipped.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))


def to_frames(elements: DataFrame) -> DataFrame:
    """Corner boxes to x, y, width, height with sides of at least one pixel."""
    return elements.withColumns(
        {
            "x": F.col("x1"),
            "y": F.col("y1"),
            "width": F.greatest(F.col("x2") - F.col("x1"), F.lit(1)),
            "height": F.greatest(F.col("y2") - F.col("y1"), F.lit(1)),
        }
    ).drop("x1", "y1", "x2", "y2")


def _square(width: Column, height: Column) -> Column:
    low, high = V.BLOB_ASPECT
    big = (width >= V.BLOB_MIN_SIDE) & (height >= V.BLOB_MIN_SIDE)
    return big & (width / F.nullif(height, F.lit(0))).between(low, high)


def is_blob_noise(text: Column | str, width: Column, height: Column) -> Column:
    """Blank, or a square box with at most two characters that are neither letters nor digits."""
    trimmed = F.trim(col(text))
    wordless = ~trimmed.rlike(r"[\p{L}\p{N}]") & (F.length(trimmed) <= 2)
    return (trimmed == "") | (wordless & F.coalesce(_square(width, height), F.lit(False)))


def is_square_code(text: Column | str, width: Column, height: Column) -> Column:
    """Square box with at most two characters of any kind (a matrix code)."""
    return (F.length(F.trim(col(text))) <= 2) & F.coalesce(_square(width, height), F.lit(False))


# --- rows -----------------------------------------------------------------------


def cluster_positions(
    elements: DataFrame, value: str, tolerance: str, keys: Sequence[str] = PAGE, running_mean: bool = True
) -> DataFrame:
    """Rows along one axis: (keys, value, row_at), one line per distinct position.

    Positions are read in order; each joins the current row if it is within the
    tolerance of the row's running mean (or of its first position).  ``row_at`` is
    the first position of the row.  ``tolerance`` must be constant per page.
    """
    points = elements.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"), F.max(tolerance).alias("_tol"))
    along = Window.partitionBy(*keys).orderBy(value)
    starts = F.coalesce(F.col(value) - F.lag(value).over(along) > F.col("_tol"), F.lit(True))
    stretches = points.withColumn("_new", starts.cast("int")).withColumn(
        "_stretch", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0))
    )
    item = F.struct(F.col(value).cast("double").alias("v"), F.col("_n").cast("double").alias("n"), F.col("_tol").cast("double").alias("t"))
    folded = stretches.groupBy(*keys, "_stretch").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    done_type = "array<struct<v:double,row_at:double>>"

    def step(state: Column, x: Column) -> Column:
        centre = state["total"] / state["n"] if running_mean else state["row_at"]
        same = (state["n"] > 0) & (F.abs(x["v"] - centre) <= x["t"])
        row_at = F.when(same, state["row_at"]).otherwise(x["v"])
        placed = F.struct(x["v"].alias("v"), row_at.alias("row_at"))
        return F.struct(
            F.concat(state["done"], F.array(placed)).cast(done_type).alias("done"),
            row_at.alias("row_at"),
            (F.when(same, state["total"]).otherwise(F.lit(0.0)) + x["v"] * x["n"]).alias("total"),
            (F.when(same, state["n"]).otherwise(F.lit(0.0)) + x["n"]).alias("n"),
        )

    first = F.element_at("_items", 1)
    start = F.struct(
        F.array(F.struct(first["v"].alias("v"), first["v"].alias("row_at"))).cast(done_type).alias("done"),
        first["v"].alias("row_at"),
        (first["v"] * first["n"]).alias("total"),
        first["n"].alias("n"),
    )
    rest = F.slice("_items", F.lit(2), F.greatest(F.size("_items") - 1, F.lit(0)))
    placed = F.aggregate(rest, start, step, lambda s: s["done"])
    return folded.select(*keys, F.inline(placed)).withColumnRenamed("v", value)


def layout_rows(elements: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Elements with ``row_at``, their visual row, after the noise filter."""
    kept = elements.where(~is_blob_noise("text", F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))).withColumn(
        "cy", (F.col("y1") + F.col("y2")) / 2.0
    )
    heights = kept.groupBy(*keys).agg(
        (F.median(F.col("y2") - F.col("y1")) * V.ROW_TOLERANCE_RATIO).alias("row_tolerance")
    )
    measured = kept.join(heights, list(keys))
    rows = cluster_positions(measured, "cy", "row_tolerance", keys)
    return measured.join(rows, [*keys, "cy"])


def layout_text(elements: DataFrame, keys: Sequence[str] = PAGE, width: str = "page_width") -> DataFrame:
    """(page, row_no, text): cells of each visual row, ' | ' where the gap is wide.

    One output row per visual row; the page text is these rows in order.
    """
    rows = layout_rows(elements, keys)
    in_row = Window.partitionBy(*keys, "row_at").orderBy("x1", "element_idx")
    wide = F.col("x1") - F.lag("x2").over(in_row) > F.col(width) * V.COLUMN_GAP_RATIO
    cell = F.when(F.coalesce(wide, F.lit(False)), F.concat(F.lit("| "), F.col("text"))).otherwise(F.col("text"))
    cells = rows.select(*keys, "row_at", F.struct("x1", "element_idx", cell.alias("cell")).alias("_cell"))
    texts = cells.groupBy(*keys, "row_at").agg(F.array_sort(F.collect_list("_cell")).alias("_cells"))
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("row_at"))
    return texts.select(
        *keys, number.alias("row_no"), F.array_join(F.transform("_cells", lambda c: c["cell"]), " ").alias("text")
    )


def reading_order(
    lines: DataFrame,
    keys: Sequence[str] = PAGE,
    tolerance: float = V.READING_ROW_TOLERANCE,
    strips: Column | None = None,
) -> DataFrame:
    """Adds ``row_at`` and ``reading_no``: rows top to bottom, left to right inside a row.

    A row holds lines at most ``tolerance`` below its first line, which makes the order
    total.  With ``strips`` a huge page is numbered strip by strip in separate tasks.
    """
    measured = lines.withColumn("_tol", F.lit(float(tolerance))).withColumn("_y", F.col("y").cast("double"))
    rows = cluster_positions(measured, "_y", "_tol", keys, running_mean=False)
    placed = measured.join(rows, [*keys, "_y"]).drop("_tol", "_y")
    order = [F.col("row_at"), F.col("x"), F.col("element_idx")]
    return positions(placed, keys, order, "reading_no", strips)


# --- sorted streaming folds ---------------------------------------------------------


def _sorted_labels(
    df: DataFrame, keys: Sequence[str], order: str, inputs: Sequence[str], make_step: Callable[[], Callable], out: str
) -> DataFrame:
    """Add a label per row from a constant-memory fold over rows sorted by (keys, order).

    Rows stream through in Arrow batches, so no group is ever held whole; other columns
    pass through untouched.  ``make_step()`` gives a function (key, order, *inputs) -> label.
    """
    keys, inputs = list(keys), list(inputs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make_step()
        for batch in batches:
            groups = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            values = [batch.column(c).to_pylist() for c in (order, *inputs)]
            labels = pa.array([step(g, *v) for g, *v in zip(groups, *values, strict=True)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, labels], names=[*batch.schema.names, out])

    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + f", `{out}` long"
    return df.repartition(*keys).sortWithinPartitions(*keys, order).mapInArrow(run, schema)


def merge_adjacent(lines: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Join neighbouring boxes of one text row: small gap, or a larger one across a matrix code.

    Lines are taken in (row, x) order.  Pages are sorted and folded where one shuffle puts them, with nothing written;
    pages too large for one task are cut into stretches.
    """
    keys = list(keys)
    hot = hot_keys(lines, keys)
    if hot is None:
        return _folded_boxes(lines, keys).unionByName(_stretched_boxes(lines.where(F.lit(False)), keys, None))
    hot = F.broadcast(hot)  # at most a row for HOT_ROWS rows
    strips = F.floor(F.col("row_at") / BAND_PIXELS).cast("int")
    large = _stretched_boxes(lines.join(hot, keys, "left_semi"), keys, strips)
    return _folded_boxes(lines.join(hot, keys, "left_anti"), keys).unionByName(large)


def _box_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    sizes = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    return df.select(*keys, "text", *sizes, F.col("element_idx").cast("long").alias("element_idx"))


def _folded_boxes(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Boxes of pages that fit a task, by a fold over rows sorted by page, codes first, then from the top.

    The fold keeps the codes of a page, one row of its lines and the texts of the running box.
    """
    rows = _box_rows(lines, keys)
    schema, n_keys = rows.schema, len(keys)
    tagged = rows.withColumn("_code", is_square_code("text", F.col("width"), F.col("height"))).where("_code is not null")
    placed = tagged.repartition(*keys).sortWithinPartitions(*keys, F.desc("_code"), F.asc_nulls_last("y"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold, page, types = _PageFold(), None, None

        def made() -> Iterator[pa.RecordBatch]:
            if fold.done:
                columns = [pa.array(c, t) for c, t in zip(zip(*fold.done, strict=True), types, strict=True)]
                fold.done = []
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        for batch in batches:
            types = batch.schema.types[:-1]
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if row[:n_keys] != page:
                    page = row[:n_keys]
                    fold.open_page(page)
                if row[-1]:
                    fold.done.append(row[:-1])
                    fold.add_code(*row[n_keys + 1 : n_keys + 5])
                elif None not in page:
                    fold.add_line(*row[n_keys:-1])
            yield from made()
        fold.open_page(None)
        yield from made()

    return placed.mapInArrow(run, schema)


class _PageFold:
    """Text lines of a page from the top: ordered within their row, joined to boxes (``done``)."""

    def __init__(self) -> None:
        self.done, self.row = [], []
        self.box = None
        self.open_page(None)

    def open_page(self, page: tuple | None) -> None:
        self._end_row()
        self._end_box()
        self.page, self.number, self.codes, self.ordered = page, 0, {}, False

    def add_code(self, x, y, width, height) -> None:
        # a wider code does not fit into the gap; as codes are almost square, the others reach over few bands
        if None not in (x, y, width, height) and width < V.MERGE_GAP_ACROSS_BLOB:
            for band in range(int(y // CODE_BAND), int((y + height) // CODE_BAND) + 1):
                self.codes.setdefault(band, []).append((x, x + width, y, y + height))

    def add_line(self, text, x, y, width, height, index) -> None:
        if self.row:
            first = self.row[0][3]
            if (first is None) != (y is None) or (y is not None and y - first > MERGE_ROW_PIXELS):
                self._end_row()
        self.row.append((x is None, x, index, y, width, height, text))

    def _end_row(self) -> None:
        if len(self.row) > 1:
            self.row.sort(key=lambda r: r[:3] if r[1] is not None else (True, 0.0, r[2]))
        for _, x, _, y, width, height, text in self.row:
            self.number += 1
            if self.box is not None and _joins(self.box, x, y, width, height, self._across):
                self.box = _grown(self.box, x, y, width, height)
                self.texts.append(text)
            else:
                self._end_box()
                self.box, self.texts, self.first = _sides(x, y, width, height), [text], self.number
        self.row = []

    def _end_box(self) -> None:
        if self.box is not None:
            x, y, right, bottom = self.box
            texts = [t for t in self.texts if t is not None]
            width, height = None if right is None else right - x, None if bottom is None else bottom - y
            self.done.append((*self.page, " ".join(texts) if texts else None, x, y, width, height, self.first))
        self.box = None

    def _across(self, box: tuple, x: float) -> bool:
        if not self.ordered:
            for near in self.codes.values():
                near.sort()
            self.ordered = True
        low, high = box[1] // CODE_BAND, box[3] // CODE_BAND
        bands = range(int(low), int(high) + 1) if high - low < len(self.codes) else [b for b in self.codes if low <= b <= high]
        for near in (self.codes[b] for b in bands if b in self.codes):
            for i in range(bisect_right(near, box[2], key=lambda c: c[0]), len(near)):
                left, right, top, bottom = near[i]
                if left >= x:
                    break
                if right < x and min(bottom, box[3]) > max(top, box[1]):
                    return True
        return False


def _sides(x, y, width, height) -> tuple:
    """Left, top, right, bottom; unknown if a number they come from is."""
    return x, y, None if x is None or width is None else x + width, None if y is None or height is None else y + height


def _grown(box: tuple, x, y, width, height) -> tuple:
    return min(box[0], x), min(box[1], y), max(box[2], x + width), max(box[3], y + height)


def _joins(box: tuple, x, y, width, height, across: Callable) -> bool:
    """Does a line join the running box?  ``across`` tells whether a code lies between them; nothing joins across unknown sides."""
    if None in box or None in (x, y, width, height):
        return False
    level = abs((y + (y + height)) - (box[1] + box[3])) / 2 <= V.MERGE_ROW_TOLERANCE
    gap = x - box[2]
    return level and (gap <= V.MERGE_GAP or (gap <= V.MERGE_GAP_ACROSS_BLOB and across(box, x)))


def _stretched_boxes(lines: DataFrame, keys: list[str], strips: Column | None) -> DataFrame:
    """Boxes of pages of any size.

    A line can only join the running box if its centre is within reach of some earlier
    centre, so each page is first cut where the running maximum of the centres falls
    behind; the fold then runs per stretch.
    """
    code = is_square_code("text", F.col("width").cast("double"), F.col("height").cast("double"))
    tall = lines.withColumn("_cy", F.col("y") + F.col("height") / 2.0)
    text = reading_order(tall.where(~code), keys, MERGE_ROW_PIXELS, strips)
    if strips is not None:
        text = checkpointed(text)
    order = [F.col("reading_no")]
    reached = running(text, keys, order, F.col("_cy"), "_reach", strips, "max", include_current=False)
    cut = F.coalesce(F.col("_cy") > F.col("_reach") + V.MERGE_ROW_TOLERANCE, F.lit(True)).cast("long")
    cut_lines = checkpointed(running(reached, keys, order, cut, "_stretch", strips))  # read twice
    codes = lines.where(code)
    bridged = _bridged(cut_lines, codes, keys)
    sizes = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")]
    ready = bridged.select(*keys, "_stretch", "reading_no", "text", *sizes, "_bridges")
    inputs = ["x", "y", "width", "height", "_bridges"]
    labelled = _sorted_labels(ready, [*keys, "_stretch"], "reading_no", inputs, _box_step, "_box")
    boxes = labelled.groupBy(*keys, "_stretch", "_box").agg(
        F.array_sort(F.collect_list(F.struct("reading_no", "text"))).alias("_parts"),
        F.min("x").alias("x"),
        F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("_right"),
        F.max(F.col("y") + F.col("height")).alias("_bottom"),
        F.min("reading_no").alias("element_idx"),
    )
    texts = F.array_compact(F.transform("_parts", lambda p: p["text"]))
    merged = boxes.select(
        *keys,
        F.when(F.size(texts) > 0, F.array_join(texts, " ")).alias("text"),
        "x",
        "y",
        (F.col("_right") - F.col("x")).alias("width"),
        (F.col("_bottom") - F.col("y")).alias("height"),
        "element_idx",
    )
    return _box_rows(merged, keys).unionByName(_box_rows(codes, keys))


def _bridged(lines: DataFrame, codes: DataFrame, keys: list[str]) -> DataFrame:
    """Attach the frames of the page's matrix codes that lie left of a line and within reach of it."""
    frames = codes.select(
        *keys,
        F.struct(
            F.col("x").cast("double").alias("x"),
            (F.col("x") + F.col("width")).cast("double").alias("right"),
            F.col("y").cast("double").alias("y"),
            (F.col("y") + F.col("height")).cast("double").alias("bottom"),
        ).alias("_code"),
    )
    near = (F.col("_code.right") < F.col("x")) & (F.col("_code.x") > F.col("x") - V.MERGE_GAP_ACROSS_BLOB)
    on_page = lines.select(*keys, "reading_no", "x").distinct().join(frames, keys).where(near)
    found = on_page.groupBy(*keys, "reading_no").agg(F.collect_set("_code").alias("_bridges"))
    return lines.join(found, [*keys, "reading_no"], "left")


def _box_step() -> Callable:
    """Label: reading number of the first line of the running box."""
    group, box, label = None, None, -1

    def step(key, number, x, y, width, height, bridges) -> int:
        nonlocal group, box, label

        def across(box, x) -> bool:
            return any(c["x"] > box[2] and min(c["bottom"], box[3]) > max(c["y"], box[1]) for c in bridges or ())

        if key == group and _joins(box, x, y, width, height, across):
            box = _grown(box, x, y, width, height)
        else:
            group, box, label = key, _sides(x, y, width, height), number
        return label

    return step


# --- sections ------------------------------------------------------------------------


def _anchor_keys(detected: Column, inline: Column, signal: Column) -> Column:
    hits = []
    for key, words in V.SECTION_ANCHORS:
        same, inside = F.lit(False), F.lit(False)
        for word in words:
            same = same | (detected == word)
            inside = inside | F.contains(detected, F.lit(word))
        if key != "medication":
            inside = inside & ~signal
        hits.append(F.when(~inline & (same | inside), F.lit(key)))
    return F.array_compact(F.array(*hits))


def assign_sections(lines: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Each line with its ``section``: anchors open vertical regions, most overlap wins.

    lines(page_id, element_idx, text, x, y, width, height).  Anchor lines are dropped.
    Regions of one page are cut at the next anchor, so they overlap a line only near
    their borders; lines meet regions through shared horizontal bands, not page-wide.
    """
    keys = list(keys)
    def read(detected: Column) -> Column:
        starts = detected.rlike(ascii_bounds(r"^medication\b")) | detected.rlike("^藥名")
        signal = detected.rlike(ascii_bounds(V.MEDICINE_SIGNAL))
        facts = F.struct(detected.alias("text"), signal.alias("signal"), (starts & signal).alias("inline"))

        def tag(s: Column) -> Column:
            return F.struct(
                s["inline"].alias("inline"), _anchor_keys(s["text"], s["inline"], s["signal"]).alias("anchors")
            )

        return let(facts, tag)

    filled = lines.where(F.trim("text") != "")
    # worked out once a line, also where a filter asks for it, and written once: four branches read it
    tagged = checkpointed(
        filled.select("*", F.inline(F.array(let(O.detection_form("text"), read)))).withColumnsRenamed({"inline": "_inline", "anchors": "_anchors"})
    )
    anchors = tagged.select(*keys, "element_idx", "x", "y", F.explode("_anchors").alias("section"))
    order = F.create_map(*[F.lit(v) for i, (k, _) in enumerate(V.SECTION_ANCHORS) for v in (k, i)])
    anchors = anchors.withColumn("_no", F.element_at(order, F.col("section")))
    # Equal anchors of one spot give equal regions, so anchors are reduced to distinct spots first.
    spots = anchors.groupBy(*keys, "section", "_no", "x", "y").agg(F.min("element_idx").alias("element_idx"))
    bottoms = tagged.groupBy(*keys).agg(F.max(F.col("y") + F.col("height")).alias("_bottom"))
    along = Window.partitionBy(*keys).orderBy("y", "x", "element_idx", "_no")
    regions = spots.withColumn("_next", F.lead("y").over(along)).join(bottoms, keys).select(
        *keys,
        "section",
        F.struct("y", "x", "element_idx", "_no").alias("_rank"),
        F.col("x").alias("_left"),
        F.greatest(F.col("y") - V.SECTION_PADDING, F.lit(0)).cast("double").alias("_top"),
        F.when(F.col("_next").isNotNull(), F.greatest(F.col("y"), F.col("_next") - V.SECTION_PADDING))
        .otherwise(F.col("_bottom") + V.SECTION_PADDING)
        .cast("double")
        .alias("_end"),
    )
    band = lambda c: F.floor(c / 64).cast("int")
    body = tagged.where(F.size("_anchors") == 0)
    boxed = body.select(*keys, "element_idx", "text", "x", "y", "height", "_inline").withColumn(
        "_band", F.explode(F.sequence(band(F.col("y")), band(F.col("y") + F.col("height"))))
    )
    spread = regions.withColumn("_band", F.explode(F.sequence(band(F.col("_top")), band(F.greatest("_top", "_end")))))
    overlap = F.least(F.col("y") + F.col("height"), F.col("_end")) - F.greatest(F.col("y"), F.col("_top"))
    fits = (overlap > 0) & ((F.col("x") >= F.col("_left")) | ((F.col("section") == "medication") & F.col("_inline")))
    best = (
        boxed.join(spread, [*keys, "_band"])
        .where(fits)
        .groupBy(*keys, "element_idx")
        .agg(F.min_by("section", F.struct(-overlap, F.col("_rank"))).alias("_section"))
    )
    quantity = (F.col("_section") == "medication") & O.is_quantity_only("text")
    return body.join(best, [*keys, "element_idx"], "left").withColumn(
        "section", F.when(F.col("_section").isNull() | quantity, "unassigned").otherwise(F.col("_section"))
    ).drop("_section", "_anchors", "_inline")


# --- line groups ------------------------------------------------------------------------


def _content(text: str) -> Column:
    """text without its inline header, from_header, and whether the line is neither label nor quantity."""
    stripped = F.struct(O.strip_inline_header(text).alias("text"), O.is_inline_header(text).alias("from_header"))
    return let(
        stripped,
        lambda s: F.struct(
            s["text"].alias("text"),
            s["from_header"].alias("from_header"),
            ((F.length(s["text"]) > 0) & ~O.is_quantity_only(s["text"]) & ~O.is_label_noise(s["text"])).alias("_kept"),
        ),
    )


def group_lines(lines: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Lines with ``group_no``: continuation lines below an aligned line join its group.

    ``group_no`` is the reading number of the group's first line.  The fold keeps the
    frame and the texts of the running group.
    """
    keys = list(keys)
    # read once a line: columns of a filter would be worked out again for each of its tests
    kept = lines.select(
        *[c for c in lines.columns if c != "text"], F.inline(F.filter(F.array(_content("text")), lambda s: s["_kept"]))
    ).drop("_kept")
    header = F.col("text").rlike(V.HEADER)
    # A header line always opens a group, so the lines between two headers fold on their own.
    strips = _strips(lines, keys)
    ordered = reading_order(kept, keys, strips=strips)
    if strips is not None:
        ordered = checkpointed(ordered)
    placed = running(ordered, keys, [F.col("reading_no")], header.cast("long"), "_stretch", strips)
    keys = [*keys, "_stretch"]
    ordered = placed.select(
        *keys,
        "reading_no",
        "element_idx",
        "text",
        "from_header",
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")],
        header.alias("_header"),
        O.is_continuation("text").alias("_continues"),
        O.starts_new_item("text").alias("_starts"),
    )
    inputs = ["x", "y", "width", "height", "_header", "_continues", "text", "_starts"]
    out = _sorted_labels(ordered, keys, "reading_no", inputs, _group_step, "group_no")
    return out.drop("_stretch", "_header", "_continues", "_starts")


def _group_step() -> Callable:
    """Label: reading number of the first line of the running group.

    Whether a group is complete is asked of its joined text, as a dose may be split over two lines.
    """
    group, box, parts, label = None, None, [], -1
    totals = [re.compile(p, re.ASCII) for p in (V.TOTAL_UNIT, V.TOTAL_ANY, V.TOTAL_ENGLISH)]
    details = [re.compile(ascii_bounds(p), re.ASCII) for p in (V.DOSAGE, V.CONTAINER_WORD, V.QUANTIFIER, r"\(")]

    def complete() -> bool:
        text = " ".join(parts)
        for total in totals:
            text = total.sub("", text)
        return any(d.search(text) for d in details)

    def fits(x, y, width, starts) -> bool:
        shared = max(0.0, min(box[2], x + width) - max(box[0], x))
        ratio, shift = shared / max(1.0, min(box[2] - box[0], width)), abs(box[0] - x)
        aligned = ratio >= V.GROUP_OVERLAP or shift <= V.GROUP_ALIGN_TOLERANCE
        far = ratio < V.GROUP_FAR_OVERLAP and shift > V.GROUP_FAR_X
        near = 0 <= y - box[3] <= max(24.0, 2.2 * (box[3] - box[1]))
        return aligned and near and not far and not (starts and complete())

    def step(key, number, x, y, width, height, header, continues, text, starts) -> int:
        nonlocal group, box, parts, label
        own = (x, y, x + width, y + height)
        if key == group and continues and not header and fits(x, y, width, starts):
            box = (min(box[0], own[0]), min(box[1], own[1]), max(box[2], own[2]), max(box[3], own[3]))
            parts.append(text)
        else:
            group, box, parts, label = key, own, [text], number
        return label

    return step


def group_boxes(grouped: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """One row per group: joined text without quantities, frame, header flag. Moved lines (_moved), if any, come last."""
    moved = F.col("_moved") if "_moved" in grouped.columns else F.lit(False)
    return (
        grouped.groupBy(*keys, "group_no")
        .agg(
            F.array_sort(F.collect_list(F.struct(moved.alias("moved"), "reading_no", "text"))).alias("_parts"),
            F.min("x").alias("x"),
            F.min("y").alias("y"),
            F.max(F.col("x") + F.col("width")).alias("_right"),
            F.max(F.col("y") + F.col("height")).alias("_bottom"),
            F.max("from_header").alias("from_header"),
        )
        .select(
            *keys,
            "group_no",
            O.strip_trailing_quantity(F.array_join(F.transform("_parts", lambda p: p["text"]), " ")).alias("text"),
            "x",
            "y",
            (F.col("_right") - F.col("x")).alias("width"),
            (F.col("_bottom") - F.col("y")).alias("height"),
            "from_header",
        )
    )


def nearest_column(boxes: DataFrame, keys: Sequence[str] = PAGE, band: int = 256) -> DataFrame:
    """(page, group_no, target_no): left-column header groups attached to the nearest right-hand group.

    Groups meet through horizontal bands of the page (a group reaches as far as its own
    height allows), so a page is never joined with itself as a whole.
    """
    keys = list(keys)
    centre = F.col("y") + F.col("height") / 2.0
    reach = F.greatest(F.lit(30.0), F.col("height") * 1.8)
    left = boxes.where(F.col("from_header") & (F.col("x") < V.COLUMN_SPLIT_X)).select(
        *keys, "group_no", centre.alias("_cy"), F.col("height").alias("_h"), reach.alias("_reach")
    )
    left = left.withColumn(
        "_band",
        F.explode(
            F.sequence(
                F.floor((F.col("_cy") - F.col("_reach")) / band).cast("int"),
                F.floor((F.col("_cy") + F.col("_reach")) / band).cast("int"),
            )
        ),
    )
    right = boxes.where((F.col("x") >= V.COLUMN_SPLIT_X) & ~O.is_label_noise("text")).select(
        *keys,
        F.col("group_no").alias("target_no"),
        centre.alias("_tcy"),
        F.col("height").alias("_th"),
        F.floor(centre / band).cast("int").alias("_band"),
    )
    away = F.abs(F.col("_cy") - F.col("_tcy"))
    allowed = F.greatest(F.lit(30.0), F.least("_h", "_th") * 1.8)
    return (
        left.join(right, [*keys, "_band"])
        .where((F.col("group_no") != F.col("target_no")) & (away <= allowed))
        .groupBy(*keys, "group_no")
        .agg(F.min_by("target_no", F.struct(away, F.col("target_no"))).alias("target_no"))
    )


def grouped_items(lines: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """Group lines, then fold attached header groups into their right-hand group."""
    keys = list(keys)
    grouped = checkpointed(group_lines(lines, keys))  # read twice
    moves = nearest_column(group_boxes(grouped, keys), keys)
    moved = grouped.join(moves, [*keys, "group_no"], "left").withColumns(
        {
            # Lines of an attached group come after the lines of the group they join.
            "_moved": F.col("target_no").isNotNull(),
            "group_no": F.coalesce("target_no", "group_no"),
        }
    )
    return group_boxes(moved.drop("target_no"), keys)
