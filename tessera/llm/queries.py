"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from tessera.llm import arc, encoding, html, langid, lm, media, mixing, neardup, prefix, quality

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_media": media.op2_media,
    "op3_html": html.op3_html,
    "op4_arc": arc.op4_arc,
    "op5_language": langid.op5_language,
    "op6_bpe": encoding.op6_bpe,
    "op7_quality": quality.op7_quality,
    "op8_prefix_counts": prefix.op8_prefix_counts,
    "op9_backoff": lm.op9_backoff,
    "op10_near_duplicates": neardup.op10_near_duplicates,
}
ORACLE_SQL = {
    "op1_mixing": mixing.SQL,
    "op4_arc": arc.SQL,
    "op7_quality": quality.SQL,
    "op9_backoff": lm.SQL,
    "op10_near_duplicates": neardup.SQL,
}
