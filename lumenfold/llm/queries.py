"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .ann import op3_nearest_vectors
from .ctw import op8_context_tree_scores
from .langid import op1_language_id
from .linededup import op6_line_dedup
from .linerules import OP12_SQL, op12_line_rules
from .mixing import OP7_SQL, op7_source_mix
from .neardup import op2_near_duplicates
from .phrases import OP13_SQL, op13_collocations
from .pieces import op10_piece_sampling
from .quality import op5_weak_quality
from .toolcalls import OP4_SQL, op4_tool_calls
from .treaps import OP11_SQL, op11_ranked_search
from .vecdup import op9_vector_duplicates

QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_near_duplicates, op3_nearest_vectors, op4_tool_calls, op5_weak_quality,
        op6_line_dedup, op7_source_mix, op8_context_tree_scores, op9_vector_duplicates, op10_piece_sampling,
        op11_ranked_search, op12_line_rules, op13_collocations,
    )
}
SQL = {"op4_tool_calls": OP4_SQL, "op7_source_mix": OP7_SQL, "op11_ranked_search": OP11_SQL, "op12_line_rules": OP12_SQL, "op13_collocations": OP13_SQL}
