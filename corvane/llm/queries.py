"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from corvane.llm import bpe, chat, embeddings, lines, mixing, negatives, ngram_join, oracles, quality, repair, substring, suffixes, token_files, toxicity


def queries() -> dict:
    found = [mixing.op1_mix_sources, lines.op2_line_dedup, token_files.op3_token_files, substring.op4_substring_dedup, chat.op5_chat_windows, embeddings.op6_embedding_dedup, ngram_join.op7_ngram_join, suffixes.op8_suffix_dedup, quality.op9_quality_rules, bpe.op10_bpe_round_trip, toxicity.op11_toxicity, negatives.op12_hard_negatives, repair.op13_conversation_repair]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_mix_sources": mixing.ORACLE, "op2_line_dedup": oracles.OP2, "op4_substring_dedup": oracles.OP4, "op5_chat_windows": oracles.OP5, "op6_embedding_dedup": oracles.OP6, "op7_ngram_join": oracles.OP7, "op12_hard_negatives": oracles.OP12}
