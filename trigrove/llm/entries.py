"""The operators' queries over the driver's tables, and their DuckDB SQL where it can express them."""

from __future__ import annotations

from trigrove.llm import jaccard, mixing, packing, parsing, quality, suffixes, toxicity, urls, vectors, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_vectors": vectors.query,
        "op3_urls": urls.query,
        "url_rules": urls.rules_query,
        "op4_jaccard": jaccard.query,
        "op5_parsing": parsing.query,
        "op6_packing": packing.query,
        "op7_suffixes": suffixes.query,
        "op8_quality": quality.query,
        "op9_toxicity": toxicity.query,
        "op10_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": warc.SQL, "op2_vectors": vectors.SQL, "url_rules": urls.RULES_SQL, "op4_jaccard": jaccard.SQL, "op7_suffixes": suffixes.SQL, "op10_mixing": mixing.SQL}
