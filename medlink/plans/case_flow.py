"""From case texts to detected items and interactions, for all cases at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from medlink.functions import ocr_text as O
from medlink.functions.case_fields import text_lines
from medlink.operators import cases as G
from medlink.operators import interactions as D
from medlink.operators.keyed import checkpointed
from medlink.operators.matching import Dictionary, match_brands, match_lines


def case_lines(cases: DataFrame, merge: bool = True, max_lines: int | None = None) -> DataFrame:
    """(case_id, input_index, input_text) from raw case texts, open lines merged first.

    ``max_lines`` reproduces the 15-line limit of the original call; by default every line counts.
    """
    lines = text_lines("ocr_raw_text")
    merged = F.transform(O.merge_open_lines(lines), lambda x: x["text"]) if merge else lines
    out = cases.select("case_id", F.posexplode(merged).alias("input_index", "input_text"))
    return out if max_lines is None else out.where(F.col("input_index") < max_lines)


def case_flow(cases: DataFrame, d: Dictionary, pairs: DataFrame, templates: DataFrame) -> dict[str, DataFrame]:
    lines, d = case_lines(cases), d.materialised()
    matches = checkpointed(match_lines(lines, d))  # read by the cards and by the ingredient sets
    brands = match_brands(lines, d)
    items = G.detected_items(matches, brands, G.brand_ingredients(brands, d.product_ingredients))
    found = D.interactions(G.case_ingredients(matches), pairs, templates)
    return {"lines": lines, "matches": matches, "items": items, "interactions": found}
