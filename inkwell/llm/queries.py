"""The numbered operators as named queries over the given tables, with SQL where it can express them."""

from __future__ import annotations

from inkwell.llm.conversations import OP11_SQL, op11_conversations
from inkwell.llm.line_rules import OP6_SQL, op6_line_rules
from inkwell.llm.mixing import op4_cube_mix
from inkwell.llm.negatives import OP12_SQL, op12_hard_negatives
from inkwell.llm.ngram_join import OP10_SQL, op10_ngram_join
from inkwell.llm.page_text import OP13_SQL, op13_main_text
from inkwell.llm.packing import op3_best_fit
from inkwell.llm.privacy import op5_privacy
from inkwell.llm.quality import op2_quality
from inkwell.llm.repeats import op8_repeats
from inkwell.llm.token_files import op7_token_files
from inkwell.llm.vector_forest import OP9_SQL, op9_vector_forest
from inkwell.llm.warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_quality": op2_quality,
    "op3_best_fit": op3_best_fit,
    "op4_cube_mix": op4_cube_mix,
    "op5_privacy": op5_privacy,
    "op6_line_rules": op6_line_rules,
    "op7_token_files": op7_token_files,
    "op8_repeats": op8_repeats,
    "op9_vector_forest": op9_vector_forest,
    "op10_ngram_join": op10_ngram_join,
    "op11_conversations": op11_conversations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_main_text": op13_main_text,
}
ORACLES: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op6_line_rules": OP6_SQL,
    "op9_vector_forest": OP9_SQL,
    "op10_ngram_join": OP10_SQL,
    "op11_conversations": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_main_text": OP13_SQL,
}
