"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import op1_mixing, op2_urls, op3_neighbours, op4_quality, op5_sharding, op6_bpe, op7_near_dedup, op8_substrings, op9_line_dedup, op10_pii

QUERIES = {
    "op1_mixing": op1_mixing.op1_mixing,
    "op2_url_filter": op2_urls.op2_url_filter,
    "op3_nearest_neighbours": op3_neighbours.op3_nearest_neighbours,
    "op4_quality_rules": op4_quality.op4_quality_rules,
    "op5_sharding": op5_sharding.op5_sharding,
    "op6_bpe": op6_bpe.op6_bpe,
    "op7_minhash_near_dedup": op7_near_dedup.op7_minhash_near_dedup,
    "op8_substring_dedup": op8_substrings.op8_substring_dedup,
    "op9_line_dedup": op9_line_dedup.op9_line_dedup,
    "op10_pii": op10_pii.op10_pii,
}
SQL = {
    "op1_mixing": op1_mixing.SQL,
    "op2_url_filter": op2_urls.SQL,
    "op3_nearest_neighbours": op3_neighbours.SQL,
    "op7_minhash_near_dedup": op7_near_dedup.SQL,
    "op9_line_dedup": op9_line_dedup.SQL,
}
