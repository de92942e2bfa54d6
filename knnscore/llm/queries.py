"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .chat import OP1_SQL, op1_chat_formatting
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .fingerprints import op3_document_fingerprints
from .language import op8_language_id
from .mixing import OP6_SQL, op6_mixing
from .packing import op5_best_fit_packing
from .pii import op9_pii
from .simhash import op10_simhash_near_dedup
from .substrings import op7_suffix_array_dedup
from .token_files import op2_token_files

QUERIES = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_token_files": op2_token_files,
    "op3_document_fingerprints": op3_document_fingerprints,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_mixing": op6_mixing,
    "op7_suffix_array_dedup": op7_suffix_array_dedup,
    "op8_language_id": op8_language_id,
    "op9_pii": op9_pii,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op1_chat_formatting": OP1_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op6_mixing": OP6_SQL,
}
