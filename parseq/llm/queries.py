"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from . import bpe, chat, exact, mixing, neardup, negatives, quality_model, quality_rules, substrings, suffixes, toxicity, trie, vectors

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_suffixes": suffixes.op2_suffixes,
    "op3_chat": chat.op3_chat,
    "op4_quality": quality_model.op4_quality,
    "op5_near": neardup.op5_near,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_vectors": vectors.op7_vectors,
    "op8_rules": quality_rules.op8_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_substrings": substrings.op10_substrings,
    "op10_substrings_all": substrings.op10_substrings_all,
    "op11_trie": trie.op11_trie,
    "op12_exact": exact.op12_exact,
    "op13_negatives": negatives.op13_negatives,
}

#: The others need a vocabulary's merges, hashed windows, trained models or components; tests/llm has twins of their results,
#: worked out by brute force or word by word (of op4 the score and the fit's likelihood, of op6 the score, of op8 the verdict).
ORACLE: dict[str, str] = {
    "op3_chat": chat.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_substrings": substrings.ORACLE,
    "op10_substrings_all": substrings.ORACLE_ALL,
    "op11_trie": trie.ORACLE,
    "op12_exact": exact.ORACLE,
    "op13_negatives": negatives.ORACLE,
}
