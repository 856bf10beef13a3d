"""Queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from indoorspark.llm import bpe, clusters, divergence, fingerprint, jaccard_join, language, licenses, media, mixing, near_vectors, sharding, substring, url_filter

QUERIES = {
    "op1_bpe": bpe.op1_bpe,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_fingerprint": fingerprint.op3_fingerprint,
    "op4_mixing": mixing.op4_mixing,
    "op5_language": language.op5_language,
    "op6_media": media.op6_media,
    "op7_sharding": sharding.op7_sharding,
    "op8_jaccard_join": jaccard_join.op8_jaccard_join,
    "op9_license_scan": licenses.op9_license_scan,
    "op10_substring_dedup": substring.op10_substring_dedup,
    "op11_divergence": divergence.op11_divergence,
    "op12_near_vectors": near_vectors.op12_near_vectors,
    "op13_clusters": clusters.op13_clusters,
}
SQL = {"op4_mixing": mixing.SQL, "op10_substring_dedup": substring.SQL, "op11_divergence": divergence.SQL, "op12_near_vectors": near_vectors.SQL, "op13_clusters": clusters.SQL}
