"""Registered queries of the corpus operators, with SQL where SQL can express them."""

from __future__ import annotations

from tidemark.llm import alignment, ann, chat, clustering, extraction, jaccard, langid, licenses, mixing, pieces, quality, secrets, tokencount

QUERIES = {
    "op1_source_mixing": mixing.op1_source_mixing,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_chat_format": chat.op4_chat_format,
    "op5_language_id": langid.op5_language_id,
    "op6_sentencepiece": pieces.op6_sentencepiece,
    "op7_jaccard_join": jaccard.op7_jaccard_join,
    "op8_token_counts": tokencount.op8_token_counts,
    "op9_nearest_neighbours": ann.op9_nearest_neighbours,
    "op10_html_text": extraction.op10_html_text,
    "op11_tokenizer_alignment": alignment.op11_tokenizer_alignment,
    "op12_centroid_clustering": clustering.op12_centroid_clustering,
    "op13_license_scan": licenses.op13_license_scan,
}
ORACLES = {"op3_quality_rules": quality.OP3_SQL, "op7_jaccard_join": jaccard.OP7_SQL, "op12_centroid_clustering": clustering.OP12_SQL, "op13_license_scan": licenses.OP13_SQL}
