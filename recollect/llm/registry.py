"""Queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, kmeans, license_scan, mixing, page_text, phrases, quality, secret_scan, simhash, substring_dedup, url_filter, warc


def queries():
    return {
        "op1_secrets": secret_scan.query,
        "op2_mixing": mixing.query,
        "op3_decontamination": decontaminate.query,
        "op4_warc": warc.query,
        "op5_chat": chat_format.query,
        "op6_simhash": simhash.query,
        "op7_quality": quality.query,
        "op8_substrings": substring_dedup.query,
        "op9_licenses": license_scan.query,
        "op10_urls": url_filter.query,
        "op11_phrases": phrases.query,
        "op12_main_text": page_text.query,
        "op13_centroids": kmeans.query,
    }


def oracle_sql():
    """The other queries need tests of randomness, retrieval, hashes that DuckDB lacks,
    divergences, rule tables or link propagation; tests hold them against brute force."""
    return {"op2_mixing": mixing.SQL, "op4_warc": warc.SQL, "op5_chat": chat_format.SQL, "op8_substrings": substring_dedup.SQL, "op11_phrases": phrases.SQL, "op13_centroids": kmeans.SQL}
