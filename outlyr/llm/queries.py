"""The queries of this subpackage, and their SQL where SQL can express them."""

import corpus_pipeline
from outlyr.llm import bpe, chat, filter_audit, language_id, media, minhash, mixing, ngram_join, quality_classifier, quality_rules, token_counts, url_filter, vector_codes

QUERIES = {
    "op1_ngram_join": ngram_join.query,
    "op2_url_filter": url_filter.query,
    "op3_language_id": language_id.query,
    "op4_media": media.query,
    "op5_quality_classifier": quality_classifier.query,
    "op6_bpe": bpe.query,
    "op7_chat": chat.query,
    "op8_token_counts": token_counts.query,
    "op9_quality_rules": quality_rules.query,
    "op10_mixing": mixing.query,
    "op11_minhash": minhash.query,
    "op12_vector_codes": vector_codes.query,
    "op13_filter_audit": filter_audit.query,
    "pipeline": corpus_pipeline.run,
}
ORACLES = {
    "op2_url_filter": url_filter.ORACLE,
    "op7_chat": chat.ORACLE,
    "op9_quality_rules": quality_rules.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op12_vector_codes": vector_codes.ORACLE,
    "op13_filter_audit": filter_audit.ORACLE,
}
