"""The queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from . import chat, decontaminate, exact_dedup, hard_negatives, id_files, licenses, lm_score, packing, quality, simhash, toxicity, url_filter, vector_codes


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_lm_score": lm_score.op2_lm_score,
        "op3_chat_format": chat.op3_chat_format,
        "op4_simhash": simhash.op4_simhash,
        "op5_packing": packing.op5_packing,
        "op6_decontaminate": decontaminate.op6_decontaminate,
        "op7_quality": quality.op7_quality,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_id_files": id_files.op9_id_files,
        "op10_url_filter": url_filter.op10_url_filter,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_vector_codes": vector_codes.op12_vector_codes,
        "op13_license_scan": licenses.op13_license_scan,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": exact_dedup.ORACLE, "op3_chat_format": chat.ORACLE, "op10_url_filter": url_filter.ORACLE,
        "op11_hard_negatives": hard_negatives.ORACLE, "op12_vector_codes": vector_codes.ORACLE,
    }
