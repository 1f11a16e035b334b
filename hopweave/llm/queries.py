"""The queries of this subpackage and, where SQL can express one, its DuckDB twin."""

from __future__ import annotations

from hopweave.llm import ann, chat, langid, minhash, packing, pieces, quality, substrings, vectors, warc

QUERIES = {
    "op1_minhash_near_dedup": minhash.op1_minhash_near_dedup,
    "op2_suffix_array_dedup": substrings.op2_suffix_array_dedup,
    "op3_language_id": langid.op3_language_id,
    "op4_warc_round_trip": warc.op4_warc_round_trip,
    "op5_chat_formatting": chat.op5_chat_formatting,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_sentencepiece": pieces.op7_sentencepiece,
    "op8_nearest_neighbours": ann.op8_nearest_neighbours,
    "op9_quality_classifier": quality.op9_quality_classifier,
    "op10_embedding_near_dedup": vectors.op10_embedding_near_dedup,
}
ORACLES: dict[str, str] = {
    "op4_warc_round_trip": warc.OP4_SQL,
    "op5_chat_formatting": chat.OP5_SQL,
    "op10_embedding_near_dedup": vectors.OP10_SQL,
}
