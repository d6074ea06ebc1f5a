"""The named queries of this subpackage and, where SQL can say the same, their SQL text."""

from __future__ import annotations

import corpus_pipeline
from detlake.llm import (
    context_tree,
    exact_dedup,
    histogram_search,
    html_text,
    lexical,
    mixing,
    near_join,
    personal,
    pieces,
    quality,
    token_count,
    token_files,
    whitening,
)

QUERIES = {
    "op1_token_counts": token_count.op1_token_counts,
    "op2_context_tree": context_tree.op2_context_tree,
    "op3_near_join": near_join.op3_near_join,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_personal_data": personal.op5_personal_data,
    "op6_token_files": token_files.op6_token_files,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_html_text": html_text.op8_html_text,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_mixing": mixing.op10_mixing,
    "op11_histogram_search": histogram_search.op11_histogram_search,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_whitening": whitening.op13_whitening,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op4_quality_rules": quality.OP4_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_histogram_search": histogram_search.OP11_SQL,
    "op12_lexical_search": lexical.OP12_SQL,
}
