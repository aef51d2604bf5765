"""Queries of the training-data operators, by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op6_permutation_index
from .chat import OP7_SQL, op7_chat_formatting
from .embed_dedup import op2_embedding_near_dedup
from .mixing import OP10_SQL, op10_hierarchical_mixing
from .packing import op9_cutting_stock_packing
from .quality import op8_additive_quality
from .ranked_search import OP11_SQL, op11_tput_ranked_search
from .runs import op12_lyndon_word_runs
from .simhash import op4_simhash_near_dedup
from .suffix_dedup import op1_suffix_array_dedup
from .token_counts import op13_overlap_token_counts
from .tokens import op5_wavelet_token_shards
from .warc import OP3_SQL, op3_warc_revisits

_QUERIES = (
    op1_suffix_array_dedup, op2_embedding_near_dedup, op3_warc_revisits, op4_simhash_near_dedup, op5_wavelet_token_shards,
    op6_permutation_index, op7_chat_formatting, op8_additive_quality, op9_cutting_stock_packing, op10_hierarchical_mixing,
    op11_tput_ranked_search, op12_lyndon_word_runs, op13_overlap_token_counts,
)


def queries() -> dict:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict:
    return {"op3_warc_revisits": OP3_SQL, "op7_chat_formatting": OP7_SQL, "op10_hierarchical_mixing": OP10_SQL, "op11_tput_ranked_search": OP11_SQL}
