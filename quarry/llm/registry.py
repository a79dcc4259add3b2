"""Queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from quarry.llm import chat, decontaminate, divergence, filter_audit, jaccard_join, language_cnn, mixing, ngram_lm, pii_crf, piece_codec, repetition, token_counts, warc_zip


def queries() -> dict:
    fns = [
        repetition.op1_suffix_repetition,
        pii_crf.op2_crf_spans,
        language_cnn.op3_byte_cnn,
        warc_zip.op4_zip_archives,
        jaccard_join.op5_count_rtree_join,
        chat.op6_content_parts,
        ngram_lm.op7_elias_fano_lm,
        token_counts.op8_pretoken_counts,
        mixing.op9_poisson_mixing,
        decontaminate.op10_latent_retrieval,
        filter_audit.op11_posting_list_audit,
        piece_codec.op12_prefix_table_codec,
        divergence.op13_dominance_skyband,
    ]
    return {f.__name__: f for f in fns}


def oracle_sql() -> dict[str, str]:
    return {"op4_zip_archives": warc_zip.OP4_SQL, "op5_count_rtree_join": jaccard_join.OP5_SQL, "op6_content_parts": chat.OP6_SQL, "op9_poisson_mixing": mixing.OP9_SQL, "op11_posting_list_audit": filter_audit.OP11_SQL, "op13_dominance_skyband": divergence.OP13_SQL}
