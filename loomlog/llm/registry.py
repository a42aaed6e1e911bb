"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from loomlog.llm import decontamination, exact_dedup, langid, line_dedup, neardup, packing, pii, secrets, suffix_dedup, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op1_secrets_base": secrets.op1_secrets_base,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op4_line_dedup_long": line_dedup.op4_line_dedup_long,
    "op5_near_duplicates": neardup.op5_near_duplicates,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_personal_data": pii.op8_personal_data,
    "op8_personal_data_base": pii.op8_personal_data_base,
    "op9_packing": packing.op9_packing,
    "op10_language_id": langid.op10_language_id,
}

ORACLES = {
    "op1_secrets_base": secrets.ORACLE,
    "op3_suffix_dedup": suffix_dedup.ORACLE,
    "op4_line_dedup": line_dedup.ORACLE,
    "op5_near_duplicates": neardup.ORACLE,
    "op6_exact_dedup": exact_dedup.ORACLE,
    "op8_personal_data_base": pii.ORACLE,
}
