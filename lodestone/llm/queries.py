"""Queries of this package and the SQL they are compared with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.decontamination import OP5_SQL, op5_decontamination
from lodestone.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from lodestone.llm.html_text import op11_html_text
from lodestone.llm.language_model import op7_language_model
from lodestone.llm.license_scan import OP1_SQL, op1_license_scan
from lodestone.llm.near_dedup import OP10_SQL, op10_near_dedup
from lodestone.llm.packing import op9_packing
from lodestone.llm.prefix_trie import OP12_SQL, op12_prefix_trie
from lodestone.llm.quality import op3_quality
from lodestone.llm.sharding import op8_sharding
from lodestone.llm.toxicity import op2_toxicity
from lodestone.llm.turn_repair import op13_turn_repair
from lodestone.llm.warc import OP4_SQL, op4_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": op1_license_scan,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_language_model": op7_language_model,
    "op8_sharding": op8_sharding,
    "op9_packing": op9_packing,
    "op10_near_dedup": op10_near_dedup,
    "op11_html_text": op11_html_text,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_turn_repair": op13_turn_repair,
}
ORACLE: dict[str, str] = {
    "op1_license_scan": OP1_SQL,
    "op4_warc": OP4_SQL,
    "op5_decontamination": OP5_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op10_near_dedup": OP10_SQL,
    "op12_prefix_trie": OP12_SQL,
}
