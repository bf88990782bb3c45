"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from functools import wraps

from ._shared import ship
from .chat import OP9_SQL, op9_chat_format
from .decontamination import OP7_SQL, op7_decontamination
from .edit_embedding import op5_edit_fingerprints
from .line_dedup import OP2_SQL, op2_line_dedup
from .packing import op6_best_fit_pack
from .prefix_trie import OP11_SQL, op11_prefix_trie
from .quality import op4_quality
from .runs import op13_periodic_runs
from .substring_dedup import OP8_SQL, op8_substring_dedup
from .suffix_dedup import op3_suffix_dedup
from .simhash import op10_simhash_near_dedup
from .token_counts import op12_token_counts
from .toxicity import op1_toxicity


def _shipped(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (op1_toxicity, op2_line_dedup, op3_suffix_dedup, op4_quality, op5_edit_fingerprints, op6_best_fit_pack, op7_decontamination, op8_substring_dedup, op9_chat_format, op10_simhash_near_dedup, op11_prefix_trie, op12_token_counts, op13_periodic_runs)}
ORACLE_SQL = {"op2_line_dedup": OP2_SQL, "op7_decontamination": OP7_SQL, "op8_substring_dedup": OP8_SQL, "op9_chat_format": OP9_SQL, "op11_prefix_trie": OP11_SQL}
