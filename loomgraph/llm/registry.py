"""Queries of this folder, by the names under which ``__spark_entry__`` offers them, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import oracle
from .bpe import op4_bpe
from .embedding_dedup import op3_embedding_dedup
from .language import op9_language
from .lm_scoring import op2_lm_scoring
from .near_dup import op1_near_duplicates
from .packing import op8_packing
from .search import op5_search
from .substring import op7_substring_dedup
from .token_store import op10_token_store
from .toxicity import op6_toxicity

QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_bpe": op4_bpe,
    "op5_search": op5_search,
    "op6_toxicity": op6_toxicity,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_packing": op8_packing,
    "op9_language": op9_language,
    "op10_token_store": op10_token_store,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = oracle.ORACLE_SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
