"""The queries of this subpackage, for the driver's entry module."""

from __future__ import annotations

from . import ann, chat, decontaminate, exact_dedup, hard_negatives, line_dedup, merkle, ngram_join, packing, quality, suffix_dedup, tokenfile, warc


def queries() -> dict:
    return {
        "op1_warc": warc.op1_warc,
        "op2_token_file": tokenfile.op2_token_file,
        "op3_ngram_join": ngram_join.op3_ngram_join,
        "op4_quality": quality.op4_quality,
        "op5_nearest": ann.op5_nearest,
        "op6_chat": chat.op6_chat,
        "op7_decontamination": decontaminate.op7_decontamination,
        "op8_line_dedup": line_dedup.op8_line_dedup,
        "op9_suffix_dedup": suffix_dedup.op9_suffix_dedup,
        "op10_packing": packing.op10_packing,
        "op11_exact_dedup": exact_dedup.op11_exact_dedup,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_merkle": merkle.op13_merkle,
        "warc_lookup": warc.warc_lookup,
        "line_passages": line_dedup.line_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.OP1_SQL,
        "warc_lookup": warc.LOOKUP_SQL,
        "op6_chat": chat.OP6_SQL,
        "op8_line_dedup": line_dedup.OP8_SQL,
        "line_passages": line_dedup.PASSAGES_SQL,
        "op11_exact_dedup": exact_dedup.OP11_SQL,
        "op12_hard_negatives": hard_negatives.OP12_SQL,
        "op13_merkle": merkle.OP13_SQL,
    }
