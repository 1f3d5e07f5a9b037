"""The queries of this subpackage, by name, and the SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from .arrow_file import op7_arrow_file
from .bpe import op6_bpe
from .counts import op8_token_counts
from .flat_graph import op2_flat_graph
from .multi_index import op5_multi_index
from .oracle import ORACLE_SQL  # noqa: F401
from .packing import op1_packing
from .secrets import op10_secrets
from .setsketch import op4_setsketch
from .suffixes import op3_suffix_dedup
from .toxicity import op9_toxicity

QUERIES = {
    "op1_packing": op1_packing,
    "op2_flat_graph": op2_flat_graph,
    "op3_suffix_dedup": op3_suffix_dedup,
    "op4_setsketch": op4_setsketch,
    "op5_multi_index": op5_multi_index,
    "op6_bpe": op6_bpe,
    "op7_arrow_file": op7_arrow_file,
    "op8_token_counts": op8_token_counts,
    "op9_toxicity": op9_toxicity,
    "op10_secrets": op10_secrets,
    "pipeline": corpus_pipeline.run,
}
