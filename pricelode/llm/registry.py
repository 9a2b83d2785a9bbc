"""Queries of this package by name, and the SQL that each must equal where SQL can express it."""

from . import chat_format, html_text, katz, language, media, mixing, packing, simhash, source_audit, token_counts, topk, turn_trie, url_filter


def queries():
    return {
        "op1_sum_of_squares_packing": packing.op1_sum_of_squares_packing,
        "op2_block_tree": html_text.op2_block_tree,
        "op3_branch_and_bound": topk.op3_branch_and_bound,
        "op4_hierarchical_svm": language.op4_hierarchical_svm,
        "op5_simhash_vantage_trees": simhash.op5_simhash_vantage_trees,
        "op6_redirect_equivalence": url_filter.op6_redirect_equivalence,
        "op7_whole_token_counts": token_counts.op7_whole_token_counts,
        "op8_katz_backoff": katz.op8_katz_backoff,
        "op9_systematic_mixture": mixing.op9_systematic_mixture,
        "op10_lossless_webp": media.op10_lossless_webp,
        "op11_grammar_round_trip": chat_format.op11_grammar_round_trip,
        "op12_radix_tree": turn_trie.op12_radix_tree,
        "op13_chunk_factorization": source_audit.op13_chunk_factorization,
    }


def oracle_sql():
    return {
        "op3_branch_and_bound": topk.OP3_SQL,
        "op6_redirect_equivalence": url_filter.OP6_SQL,
        "op9_systematic_mixture": mixing.OP9_SQL,
        "op11_grammar_round_trip": chat_format.OP11_SQL,
        "op12_radix_tree": turn_trie.OP12_SQL,
        "op13_chunk_factorization": source_audit.OP13_SQL,
    }
