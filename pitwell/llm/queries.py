"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pitwell.llm import exact_dedup, fill_middle, language_id, line_dedup, mixing, near_dedup, packing, piece_codec, pii, quality, spelling, substring_dedup, suffix_dedup

QUERIES = {
    "op1_mix": mixing.op1_mix,
    "op2_near_dedup": near_dedup.op2_near_dedup,
    "op3_language": language_id.op3_language,
    "op4_quality": quality.op4_quality,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_personal_data": pii.op8_personal_data,
    "op9_pieces": piece_codec.op9_pieces,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_spelling": spelling.op12_spelling,
    "op13_packing": packing.op13_packing,
}

ORACLE_SQL = {
    "op1_mix": mixing.SQL,
    "op5_exact_dedup": exact_dedup.SQL,
    "op6_line_dedup": line_dedup.SQL,
    "op11_fill_middle": fill_middle.SQL,
    "op12_spelling": spelling.SQL,
}
