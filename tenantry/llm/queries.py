"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import byte_bpe, chat_format, divergence, embedding_dedup, license_scan, line_dedup, merkle, minhash_dedup, mixing, quality_ranker, quality_rules, token_counts, warc

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_embedding_dedup": embedding_dedup.op2_embedding_dedup,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_warc_derivatives": warc.op4_warc_derivatives,
    "op5_quality_rules": quality_rules.op5_quality_rules,
    "op6_quality_ranker": quality_ranker.op6_quality_ranker,
    "op7_minhash_dedup": minhash_dedup.op7_minhash_dedup,
    "op8_line_dedup": line_dedup.op8_line_dedup,
    "op9_byte_bpe": byte_bpe.op9_byte_bpe,
    "op10_mixing": mixing.op10_mixing,
    "op11_chat_format": chat_format.op11_chat_format,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_source_divergence": divergence.op13_source_divergence,
}

SQL = {
    "op8_line_dedup": line_dedup.SQL,
    "op11_chat_format": chat_format.SQL,
    "op12_merkle_manifest": merkle.SQL,
    "op13_source_divergence": divergence.SQL,
}
