"""Registered corpus queries and, where SQL can express them, the SQL with the same rows."""

from __future__ import annotations

from . import decontaminate, fixity, url_filter
from .decontaminate import op10_benchmark_windows
from .fixity import op9_merkle_audit
from .jaccard import op5_jaccard_components
from .packing import op8_pattern_packing
from .piece_counts import op6_piece_counts
from .pseudonyms import op4_feistel_pseudonyms
from .quality import op7_quality_votes
from .repeats import op1_run_length_index
from .token_output import op3_token_volumes
from .url_filter import op2_url_rules

QUERIES = {
    "op1_run_length_index": op1_run_length_index,
    "op2_url_rules": op2_url_rules,
    "op3_token_volumes": op3_token_volumes,
    "op4_feistel_pseudonyms": op4_feistel_pseudonyms,
    "op5_jaccard_components": op5_jaccard_components,
    "op6_piece_counts": op6_piece_counts,
    "op7_quality_votes": op7_quality_votes,
    "op8_pattern_packing": op8_pattern_packing,
    "op9_merkle_audit": op9_merkle_audit,
    "op10_benchmark_windows": op10_benchmark_windows,
}
ORACLES = {
    "op2_url_rules": url_filter.ORACLE,
    "op9_merkle_audit": fixity.ORACLE,
    "op10_benchmark_windows": decontaminate.ORACLE,
}
