"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from mnemoframe.llm.complement_pack import op1_best_fit_packing
from mnemoframe.llm.conversation_repair import op11_conversation_repair
from mnemoframe.llm.decontaminate import op2_benchmark_decontamination
from mnemoframe.llm.decreasing_pack import op6_token_matrices
from mnemoframe.llm.divergence import op3_distribution_divergence
from mnemoframe.llm.language_mixture import op5_language_mixture
from mnemoframe.llm.line_dedup import op7_line_dedup
from mnemoframe.llm.near_dup import op8_minhash_near_dedup
from mnemoframe.llm.quality_model import op9_quality_classifier
from mnemoframe.llm.simhash_trie import op13_simhash_trie
from mnemoframe.llm.site_tree import op10_site_style_tree
from mnemoframe.llm.sqlchecks import CHECKS
from mnemoframe.llm.token_spans import op12_token_spans
from mnemoframe.llm.url_filter import op4_url_language_ratio

QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_benchmark_decontamination, op3_distribution_divergence, op4_url_language_ratio, op5_language_mixture,
    op6_token_matrices, op7_line_dedup, op8_minhash_near_dedup, op9_quality_classifier, op10_site_style_tree,
    op11_conversation_repair, op12_token_spans, op13_simhash_trie,
)}

__all__ = ["CHECKS", "QUERIES"]
