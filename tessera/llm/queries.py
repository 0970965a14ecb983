"""The queries opN_<name> of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tessera.llm import byte_bpe, chat_format, divergence, jaccard_join, line_dedup, mixing, quality_model, quality_rules, simhash, syncmers, time_partitions, url_filter, warc


def queries() -> dict:
    return {
        "op1_byte_bpe": byte_bpe.op1_byte_bpe,
        "op2_warc": warc.op2_warc,
        "op3_syncmers": syncmers.op3_syncmers,
        "op4_line_dedup": line_dedup.op4_line_dedup,
        "op5_url_filter": url_filter.op5_url_filter,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_simhash": simhash.op7_simhash,
        "op8_quality_model": quality_model.op8_quality_model,
        "op9_quality_rules": quality_rules.op9_quality_rules,
        "op10_mix": mixing.op10_mix,
        "op11_divergence": divergence.op11_divergence,
        "op12_time_partitions": time_partitions.op12_time_partitions,
        "op13_jaccard_join": jaccard_join.op13_jaccard_join,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc": warc.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op6_chat_format": chat_format.SQL,
        "op9_quality_rules": quality_rules.SQL,
        "op10_mix": mixing.SQL,
        "op11_divergence": divergence.SQL,
    }
