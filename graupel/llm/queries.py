"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from graupel.llm.alignment import alignment_query
from graupel.llm.bpe import bpe_roundtrip_query
from graupel.llm.compact_windows import passage_query
from graupel.llm.decontaminate import contamination_query
from graupel.llm.infill import INFILL_SQL, infill_query
from graupel.llm.jaccard_join import JACCARD_SQL, jaccard_query
from graupel.llm.katz import katz_query
from graupel.llm.language import language_query
from graupel.llm.line_dedup import line_query
from graupel.llm.quality import quality_query
from graupel.llm.sharding import sharding_query
from graupel.llm.substring_dedup import SUBSTRING_SQL, substring_query
from graupel.llm.topk import TOPK_SQL, topk_query

QUERIES = {
    "op1_random_indexing_quality": quality_query,
    "op10_compact_windows": passage_query,
    "op11_bidirectional_gru_language": language_query,
    "op12_repeated_capture_infill": infill_query,
    "op13_asof_token_alignment": alignment_query,
    "op2_greedy_string_tiling": contamination_query,
    "op3_hypergeometric_shards": sharding_query,
    "op7_katz_backoff": katz_query,
    "op9_prefix_interval_dedup": substring_query,
    "op8_parity_sketch_join": jaccard_query,
    "op4_segment_topk": topk_query,
    "op5_minhash_lines": line_query,
    "op6_byte_bpe_roundtrip": bpe_roundtrip_query,
}

SQL: dict[str, str] = {"op12_repeated_capture_infill": INFILL_SQL, "op4_segment_topk": TOPK_SQL, "op8_parity_sketch_join": JACCARD_SQL, "op9_prefix_interval_dedup": SUBSTRING_SQL}
