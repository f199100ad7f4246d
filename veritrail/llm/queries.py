"""Registered queries of this subpackage and their SQL checks."""

from __future__ import annotations

from veritrail.llm import ann, fingerprints, maxent, middle, packing, piecestream, prefixtrie, quality, sharding, simhash, surrogates, toxicity, urls
from veritrail.session import prepare

QUERIES = {
    "op1_posting_list_ann": ann.op1_posting_list_ann,
    "op2_minimum_bin_slack": packing.op2_minimum_bin_slack,
    "op3_bloom_url_filter": urls.op3_bloom_url_filter,
    "op4_streaming_viterbi": piecestream.op4_streaming_viterbi,
    "op5_multiset_fingerprints": fingerprints.op5_multiset_fingerprints,
    "op6_byte_cnn_quality": quality.op6_byte_cnn_quality,
    "op7_weak_supervision_toxicity": toxicity.op7_weak_supervision_toxicity,
    "op8_surrogate_pii": surrogates.op8_surrogate_pii,
    "op9_simhash_near_dedup": simhash.op9_simhash_near_dedup,
    "op10_hash_tree_sharding": sharding.op10_hash_tree_sharding,
    "op11_hashed_maxent": maxent.op11_hashed_maxent,
    "op12_wavelet_fim": middle.op12_wavelet_fim,
    "op13_prefix_trie": prefixtrie.op13_prefix_trie,
}
CHECKS = {"op3_bloom_url_filter": urls.OP3_SQL, "op12_wavelet_fim": middle.OP12_SQL, "op13_prefix_trie": prefixtrie.OP13_SQL}


def queries():
    return {name: (lambda spark, sf_dir, fn=fn: fn(prepare(spark), sf_dir)) for name, fn in QUERIES.items()}


def checks():
    return dict(CHECKS)
