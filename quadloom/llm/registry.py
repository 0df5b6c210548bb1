"""The queries opN_<name> of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadloom.llm import annulus, bpe, divergence, jaccard, langid, mixing, mpegts, neighbours, packing, pii, quality, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii_surrogates": pii.op1_pii_surrogates,
    "op2_byte_cnn_quality": quality.op2_byte_cnn_quality,
    "op3_kneser_ney_language": langid.op3_kneser_ney_language,
    "op4_hierarchical_mixing": mixing.op4_hierarchical_mixing,
    "op5_warc": warc.op5_warc,
    "op6_harmonic_packing": packing.op6_harmonic_packing,
    "op7_compression_toxicity": toxicity.op7_compression_toxicity,
    "op8_stable_projection_neighbours": neighbours.op8_stable_projection_neighbours,
    "op9_jaccard_join": jaccard.op9_jaccard_join,
    "op10_transport_streams": mpegts.op10_transport_streams,
    "op11_group_block_divergence": divergence.op11_group_block_divergence,
    "op12_backtracking_bpe": bpe.op12_backtracking_bpe,
    "op13_annulus_clustering": annulus.op13_annulus_clustering,
}
ORACLES: dict[str, str] = {
    "op4_hierarchical_mixing": mixing.ORACLE,
    "op5_warc": warc.ORACLE,
    "op9_jaccard_join": jaccard.ORACLE,
    "op11_group_block_divergence": divergence.ORACLE,
    "op13_annulus_clustering": annulus.ORACLE,
}
