"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from verdant.llm.decontaminate import OP4_SQL, op4_decontaminate
from verdant.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from verdant.llm.lexical_search import OP11_SQL, op11_lexical_search
from verdant.llm.line_dedup import OP10_SQL, op10_line_dedup
from verdant.llm.mixture import OP6_SQL, op6_mix_sources
from verdant.llm.ngram_join import OP2_SQL, op2_ngram_jaccard_join
from verdant.llm.packing import op13_lexical_packing
from verdant.llm.quality_gam import op7_quality_gam
from verdant.llm.quality_rules import op3_quality_rules
from verdant.llm.sanitise import op1_sanitise
from verdant.llm.substring_dedup import OP5_SQL, op5_substring_dedup
from verdant.llm.token_counts import op9_token_counts
from verdant.llm.toxicity import op8_toxicity

QUERIES = {
    f.__name__: f
    for f in (op1_sanitise, op2_ngram_jaccard_join, op3_quality_rules, op4_decontaminate, op5_substring_dedup, op6_mix_sources, op7_quality_gam, op8_toxicity, op9_token_counts, op10_line_dedup, op11_lexical_search, op12_hard_negatives, op13_lexical_packing)
}
ORACLE_SQL = {"op2_ngram_jaccard_join": OP2_SQL, "op4_decontaminate": OP4_SQL, "op5_substring_dedup": OP5_SQL, "op6_mix_sources": OP6_SQL, "op10_line_dedup": OP10_SQL, "op11_lexical_search": OP11_SQL, "op12_hard_negatives": OP12_SQL}
