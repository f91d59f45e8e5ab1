"""Queries of this package, with SQL oracles where SQL can express them."""

from __future__ import annotations

from . import centroids, chat, decontaminate, html_text, packing, passages, quality, simhash, suffix_dedup, topk, toxicity, trie, warc

QUERIES = {
    "op1_passages": passages.op1_passages,
    "op2_html": html_text.op2_html,
    "op3_packing": packing.op3_packing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_topk": topk.op5_topk,
    "op6_quality": quality.op6_quality,
    "op7_simhash": simhash.op7_simhash,
    "op8_decontamination": decontaminate.op8_decontamination,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_chat": chat.op10_chat,
    "op11_centroids": centroids.op11_centroids,
    "op12_trie": trie.op12_trie,
    "op13_warc": warc.op13_warc,
}
ORACLES = {"op5_topk": topk.ORACLE, "op10_chat": chat.ORACLE, "op11_centroids": centroids.ORACLE, "op12_trie": trie.ORACLE, "op13_warc": warc.ORACLE}
