"""Queries of this subpackage and their SQL."""

import corpus_pipeline
from velspar.llm.decontaminate import op5_benchmark_decontamination
from velspar.llm.fingerprint import op2_document_fingerprints
from velspar.llm.html_text import op6_html_extraction
from velspar.llm.katz import op7_katz_scoring
from velspar.llm.lang_id import op8_language_id
from velspar.llm.line_dedup import line_dedup_sql, op1_line_dedup
from velspar.llm.near_dup import near_duplicates_sql, op3_minhash_near_dedup
from velspar.llm.packing import op9_best_fit_packing
from velspar.llm.token_files import op4_token_ids_orc
from velspar.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_document_fingerprints": op2_document_fingerprints,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_token_ids_orc": op4_token_ids_orc,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_html_extraction": op6_html_extraction,
    "op7_katz_scoring": op7_katz_scoring,
    "op8_language_id": op8_language_id,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_toxicity": op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
ORACLE = {"op1_line_dedup": line_dedup_sql(), "op3_minhash_near_dedup": near_duplicates_sql()}
