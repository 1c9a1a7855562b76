"""The queries of this package and the SQL of those that SQL can express."""

from __future__ import annotations

from lexspan.llm.conversation_repair import OP13_SQL, op13_conversation_repair
from lexspan.llm.conversation_trie import OP12_SQL, op12_conversation_trie
from lexspan.llm.decontamination import op2_benchmark_containment
from lexspan.llm.line_dedup import op8_line_dedup
from lexspan.llm.lsh_forest import op10_lsh_forest
from lexspan.llm.maxent import op6_maxent_lm
from lexspan.llm.oracles import ORACLES as _ORACLES
from lexspan.llm.ordinal import op9_ordinal_quality
from lexspan.llm.piece_backtrack import op11_piece_backtracking
from lexspan.llm.repetition import op3_repetition_coverage
from lexspan.llm.token_counts import op7_token_counts
from lexspan.llm.token_files import op1_token_files
from lexspan.llm.transducer import op4_bpe_transducer
from lexspan.llm.url_templates import op5_url_templates

QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files,
        op2_benchmark_containment,
        op3_repetition_coverage,
        op4_bpe_transducer,
        op5_url_templates,
        op6_maxent_lm,
        op7_token_counts,
        op8_line_dedup,
        op9_ordinal_quality,
        op10_lsh_forest,
        op11_piece_backtracking,
        op12_conversation_trie,
        op13_conversation_repair,
    )
}
ORACLES = _ORACLES | {"op12_conversation_trie": OP12_SQL, "op13_conversation_repair": OP13_SQL}
