"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tesserae.llm import bwt_dedup, decontamination, hamming_index, language_id, line_dedup, near_dedup, packing, personal_data, secret_scan, substring_dedup

QUERIES = {
    "op1_language_id": language_id.op1,
    "op2_substring_dedup": substring_dedup.op2,
    "op3_decontamination": decontamination.op3,
    "op4_packing": packing.op4,
    "op5_suffix_dedup": bwt_dedup.op5,
    "op6_line_dedup": line_dedup.op6,
    "op7_personal_data": personal_data.op7,
    "op8_near_dedup": near_dedup.op8,
    "op9_secret_scan": secret_scan.op9,
    "op10_nearest": hamming_index.op10,
}
SQL = {
    "op3_decontamination": decontamination.OP3_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
}
