"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import encoding, exact, licences, manifest, near, packing, pii, prefixes, quality, repeats, rules, sharding, tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        encoding.op1_byte_bpe,
        packing.op2_pack_sequences,
        quality.op3_quality_classifier,
        licences.op4_license_scans,
        exact.op5_exact_dedup,
        tokens.op6_token_counts,
        near.op7_minhash_near_dedup,
        rules.op8_quality_rules,
        pii.op9_pii_pseudonyms,
        sharding.op10_sharding,
        manifest.op11_merkle_manifest,
        repeats.op12_suffix_array_dedup,
        prefixes.op13_prefix_trie,
    )
}

SQL: dict[str, str] = {
    "op5_exact_dedup": exact.OP5_SQL,
    "op11_merkle_manifest": manifest.OP11_SQL,
    "op13_prefix_trie": prefixes.OP13_SQL,
}
