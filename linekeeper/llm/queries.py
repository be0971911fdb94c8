"""Queries of this package and the SQL that checks them: {name: query}, {name: SQL}."""

from __future__ import annotations

from linekeeper.llm import cross_tokens, decontaminate, near_copies, oracles, packing, prefix_bpe, prefix_trie, quality_model, quality_rules, repeats, secrets, sharding, token_files, warc


def queries() -> dict:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_ngram_jaccard_join": near_copies.op2_ngram_jaccard_join,
        "op3_token_files": token_files.op3_token_files,
        "op4_sharding": sharding.op4_sharding,
        "op5_quality_rules": quality_rules.op5_quality_rules,
        "op6_repeated_passages": repeats.op6_repeated_passages,
        "op7_warc": warc.op7_warc,
        "op8_decontaminate": decontaminate.op8_decontaminate,
        "op9_quality_model": quality_model.op9_quality_model,
        "op10_secret_scans": secrets.op10_secret_scans,
        "op11_prefix_bpe": prefix_bpe.op11_prefix_bpe,
        "op12_cross_tokens": cross_tokens.op12_cross_tokens,
        "op13_prefix_trie": prefix_trie.op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
