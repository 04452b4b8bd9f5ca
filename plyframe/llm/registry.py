"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from plyframe.llm import chats, decontaminate, langid, media, passages, sentencepieces, simhash, tokencounts, urls, webtext

QUERIES = {
    "op1_sentencepiece": sentencepieces.op1_sentencepiece,
    "op2_token_counts": tokencounts.op2_token_counts,
    "op3_simhash_near_dedup": simhash.op3_simhash_near_dedup,
    "op4_substring_dedup": passages.op4_substring_dedup,
    "op5_benchmark_decontamination": decontaminate.op5_benchmark_decontamination,
    "op6_chat_formatting": chats.op6_chat_formatting,
    "op7_url_filters": urls.op7_url_filters,
    "op8_language_id": langid.op8_language_id,
    "op9_media_columns": media.op9_media_columns,
    "op10_html_extraction": webtext.op10_html_extraction,
}

#: What SQL can express of some of them.
QUERIES |= {"url_given_rules": urls.url_given_rules, "media_payloads": media.media_payloads}

ORACLES: dict[str, str] = {
    "op5_benchmark_decontamination": decontaminate.OP5_SQL,
    "op6_chat_formatting": chats.OP6_SQL,
    "url_given_rules": urls.URL_GIVEN_RULES_SQL,
    "media_payloads": media.MEDIA_PAYLOADS_SQL,
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
