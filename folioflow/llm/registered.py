"""The queries of this subpackage and their SQL; one query for each operator."""

from folioflow.llm import decontaminate, language_id, minhash, pii, quality_rules, sentencepiece_codec, suffix_dedup, token_counts, url_filter, warc

QUERIES = {
    "op1_quality_rules": quality_rules.query,
    "op2_minhash": minhash.query,
    "op3_decontaminate": decontaminate.query,
    "op4_pii": pii.query,
    "op5_warc": warc.query,
    "op6_token_counts": token_counts.query,
    "op7_url_filter": url_filter.query,
    "op8_sentencepiece": sentencepiece_codec.query,
    "op9_suffix_dedup": suffix_dedup.query,
    "op10_language_id": language_id.query,
}
ORACLES = {
    "op1_quality_rules": quality_rules.SQL,
    "op2_minhash": minhash.SQL,
    "op3_decontaminate": decontaminate.SQL,
    "op5_warc": warc.SQL,
}
