"""The registered queries of this subpackage, and their DuckDB twins where SQL expresses them."""

from __future__ import annotations

from . import htmltext, langid, mixing, neighbours, ordermin, packing, personal, runs, secrets, simhash, substring, toxicity, whitening

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_substring_dedup": substring.op2_substring_dedup,
    "op3_source_mixing": mixing.op3_source_mixing,
    "op4_language_id": langid.op4_language_id,
    "op5_packing": packing.op5_packing,
    "op6_order_min_hash": ordermin.op6_order_min_hash,
    "op7_secret_scan": secrets.op7_secret_scan,
    "op8_learned_partitions": neighbours.op8_learned_partitions,
    "op9_html_main_text": htmltext.op9_html_main_text,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_personal_data": personal.op12_personal_data,
    "op13_periodic_runs": runs.op13_periodic_runs,
}
ORACLE_SQL: dict[str, str] = {"op2_substring_dedup": substring.ORACLE_SQL}
