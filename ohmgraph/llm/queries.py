"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from ohmgraph.llm import exact_dedup, html_extract, langid, line_dedup, mixing, near_dedup, neighbours, packing, quality, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_language_id": langid.query,
    "op3_best_fit_packing": packing.query,
    "op4_near_dedup": near_dedup.query,
    "op5_mixing": mixing.query,
    "op6_nearest": neighbours.query,
    "op7_toxicity": toxicity.query,
    "op8_html_text": html_extract.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_quality": quality.query,
}
SQL = {"op1_line_dedup": line_dedup.SQL, "op5_mixing": mixing.SQL, "op9_exact_dedup": exact_dedup.SQL}
