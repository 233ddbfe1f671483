"""Queries and oracle SQL of this subpackage, for the entry module."""

from __future__ import annotations

from .chat import OP10_SQL, op10_reply_trees
from .language import op3_language_filters
from .media import op7_wav_fingerprints
from .middle import OP12_SQL, op12_fill_in_middle
from .mixing import OP6_SQL, op6_pfair_mixing
from .near import op1_bagminhash
from .pieces import op9_streaming_viterbi
from .pii import op8_contextual_pii
from .quality import op4_repetition_coverage
from .sharding import OP13_SQL, op13_external_shuffle
from .tokens import op2_token_files
from .toxicity import op5_multiple_instance
from .whitening import op11_whitening

QUERIES = {
    "op1_bagminhash": op1_bagminhash,
    "op2_token_files": op2_token_files,
    "op3_language_filters": op3_language_filters,
    "op4_repetition_coverage": op4_repetition_coverage,
    "op5_multiple_instance": op5_multiple_instance,
    "op6_pfair_mixing": op6_pfair_mixing,
    "op7_wav_fingerprints": op7_wav_fingerprints,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_streaming_viterbi": op9_streaming_viterbi,
    "op10_reply_trees": op10_reply_trees,
    "op11_whitening": op11_whitening,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_external_shuffle": op13_external_shuffle,
}
ORACLE_SQL = {"op6_pfair_mixing": OP6_SQL, "op10_reply_trees": OP10_SQL, "op12_fill_in_middle": OP12_SQL, "op13_external_shuffle": OP13_SQL}
