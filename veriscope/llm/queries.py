"""The operators' registered queries and the SQL that checks them."""

from __future__ import annotations

from veriscope.llm import (
    chat, collocations, embedding_dedup, fill_in_middle, mixing, packing, quality, secret_scan, simhash, suffix_dedup,
    token_counts, toxicity, warc,
)

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_secret_scan": secret_scan.op3_secret_scan,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_embedding_dedup": embedding_dedup.op5_embedding_dedup,
    "op6_simhash": simhash.op6_simhash,
    "op7_toxicity": toxicity.op7_toxicity,
    "op8_chat_formatting": chat.op8_chat_formatting,
    "op9_packing": packing.op9_packing,
    "op10_warc": warc.op10_warc,
    "op11_fill_in_middle": fill_in_middle.op11_fill_in_middle,
    "op12_collocations": collocations.op12_collocations,
    "op13_suffix_dedup": suffix_dedup.op13_suffix_dedup,
}
ORACLE = {
    "op1_mixing": mixing.ORACLE,
    "op2_quality_rules": quality.ORACLE,
    "op8_chat_formatting": chat.ORACLE,
    "op10_warc": warc.ORACLE,
    "op11_fill_in_middle": fill_in_middle.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_suffix_dedup": suffix_dedup.ORACLE,
}
