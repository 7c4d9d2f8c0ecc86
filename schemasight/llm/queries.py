"""The registered queries of the subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from .align import op12_alignment
from .chat import OP13_SQL, op13_chat_trees
from .decontaminate import OP10_SQL, op10_decontamination
from .embed_graph import op8_embedding_graph
from .katz import op5_katz
from .langid import op3_language_id
from .line_dedup import OP6_SQL, op6_line_dedup
from .mixing import OP9_SQL, op9_mixing
from .sharding import OP1_SQL, op1_sharding
from .simhash import op2_simhash
from .spelling import OP11_SQL, op11_spelling
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op4_token_counts

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_simhash": op2_simhash,
    "op3_language_id": op3_language_id,
    "op4_token_counts": op4_token_counts,
    "op5_katz": op5_katz,
    "op6_line_dedup": op6_line_dedup,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_embedding_graph": op8_embedding_graph,
    "op9_mixing": op9_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_spelling": op11_spelling,
    "op12_alignment": op12_alignment,
    "op13_chat_trees": op13_chat_trees,
}
ORACLE = {
    "op1_sharding": OP1_SQL,
    "op6_line_dedup": OP6_SQL,
    "op9_mixing": OP9_SQL,
    "op10_decontamination": OP10_SQL,
    "op11_spelling": OP11_SQL,
    "op13_chat_trees": OP13_SQL,
}
