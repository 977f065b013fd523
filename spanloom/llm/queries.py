"""The operators' queries, and SQL for those that SQL expresses."""

from __future__ import annotations

from spanloom.llm import byte_bpe, decontaminate, embedding_dedup, exact_dedup, fill_middle, html_text, minhash_dedup, mixing, secret_scan, spelling, sql, suffix_dedup, toxicity, url_filter

QUERIES = {
    "op1_embedding_near_dedup": embedding_dedup.op1_embedding_near_dedup,
    "op2_url_filters": url_filter.op2_url_filters,
    "op3_byte_bpe": byte_bpe.op3_byte_bpe,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_html_extraction": html_text.op5_html_extraction,
    "op6_minhash_near_dedup": minhash_dedup.op6_minhash_near_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_mixing": mixing.op9_mixing,
    "op10_secret_scans": secret_scan.op10_secret_scans,
    "op11_fill_in_middle": fill_middle.op11_fill_in_middle,
    "op12_decontamination": decontaminate.op12_decontamination,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

SQL = sql.SQL
