"""Registered queries of the operators."""

from __future__ import annotations

import corpus_pipeline
from inkveil.llm import decontamination, prefix_trie
from inkveil.llm.compression_rules import op10_compression_rules
from inkveil.llm.decontamination import op11_decontamination
from inkveil.llm.gam_quality import op8_quality
from inkveil.llm.hash_tree import op6_sharding
from inkveil.llm.lang_id import op4_language_id
from inkveil.llm.lbl_lm import op3_lm_scoring
from inkveil.llm.multi_index import op5_near_vectors
from inkveil.llm.packing import op1_packing
from inkveil.llm.pii import op9_pii
from inkveil.llm.prefix_trie import op13_conversation_trie
from inkveil.llm.simhash import op7_simhash
from inkveil.llm.soft_mixing import op2_mixing
from inkveil.llm.spelling import op12_spelling_variants

QUERIES = {f.__name__: f for f in (
    op1_packing, op2_mixing, op3_lm_scoring, op4_language_id, op5_near_vectors,
    op6_sharding, op7_simhash, op8_quality, op9_pii, op10_compression_rules, op11_decontamination,
    op12_spelling_variants, op13_conversation_trie)}
QUERIES["pipeline"] = corpus_pipeline.run

#: The others are not SQL statements: tokens, models, checksums and iterations are tested by brute force.
ORACLES: dict[str, str] = {"op11_decontamination": decontamination.ORACLE, "op13_conversation_trie": prefix_trie.ORACLE}
