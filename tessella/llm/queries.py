"""The queries of this package, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.llm import divergence, jaccard_join, linededup
from tessella.llm.jaccard_join import op7_ngram_jaccard_join
from tessella.llm.divergence import op11_heavy_light_divergence
from tessella.llm.importance import op12_crc_importance
from tessella.llm.langid import op1_language_id
from tessella.llm.linededup import op13_cuckoo_line_dedup
from tessella.llm.licences import op9_licence_scan
from tessella.llm.media import op5_interleaved_media
from tessella.llm.mixing import op6_low_discrepancy_mix
from tessella.llm.packing import op4_pattern_packing
from tessella.llm.secrets import op8_secret_scan
from tessella.llm.sharding import op10_rendezvous_sharding
from tessella.llm.winnowing import op3_winnowing
from tessella.llm.wrappers import op2_wrapper_extraction

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_wrapper_extraction": op2_wrapper_extraction,
    "op3_winnowing": op3_winnowing,
    "op4_pattern_packing": op4_pattern_packing,
    "op5_interleaved_media": op5_interleaved_media,
    "op6_low_discrepancy_mix": op6_low_discrepancy_mix,
    "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
    "op8_secret_scan": op8_secret_scan,
    "op9_licence_scan": op9_licence_scan,
    "op10_rendezvous_sharding": op10_rendezvous_sharding,
    "op11_heavy_light_divergence": op11_heavy_light_divergence,
    "op12_crc_importance": op12_crc_importance,
    "op13_cuckoo_line_dedup": op13_cuckoo_line_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op7_ngram_jaccard_join": jaccard_join.ORACLE_SQL,
    "op11_heavy_light_divergence": op11_heavy_light_divergence,
    "op12_crc_importance": op12_crc_importance,
    "op11_heavy_light_divergence": divergence.ORACLE_SQL,
    "op13_cuckoo_line_dedup": linededup.ORACLE_SQL,
}
