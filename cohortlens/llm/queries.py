"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from . import exact, jaccard, licenses, media, packing, pieces, substrings, suffixes, toxicity, warc

QUERIES = {
    "op1_sentencepiece": pieces.query,
    "op2_exact_dedup": exact.query,
    "op3_toxicity": toxicity.query,
    "op4_suffix_dedup": suffixes.query,
    "op5_media": media.query,
    "op6_jaccard_join": jaccard.query,
    "op7_licenses": licenses.query,
    "op8_warc": warc.query,
    "op9_packing": packing.query,
    "op10_substring_dedup": substrings.query,
}
ORACLE_SQL = {"op2_exact_dedup": exact.ORACLE_SQL}
