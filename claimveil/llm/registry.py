"""Queries of this folder by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, mixing, pq, prefix_trie, secret_scan, substring_dedup, topk, window_dedup
from .collocations import op12_collocations
from .langid import op3_language_id
from .mixing import op6_pareto_mixing
from .packing import op9_best_fit_packing
from .pq import op10_pq_near_dedup
from .prefix_trie import op11_prefix_trie
from .quality import op7_quality_classifier
from .secret_scan import op8_secret_scan
from .simhash import op2_simhash_near_dedup
from .substring_dedup import op1_substring_dedup
from .token_store import op4_token_output
from .topk import op5_exact_top_k
from .window_dedup import op13_window_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_simhash_near_dedup": op2_simhash_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_token_output": op4_token_output,
    "op5_exact_top_k": op5_exact_top_k,
    "op6_pareto_mixing": op6_pareto_mixing,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_secret_scan": op8_secret_scan,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_pq_near_dedup": op10_pq_near_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_collocations": op12_collocations,
    "op13_window_dedup": op13_window_dedup,
}
ORACLES: dict[str, str] = {
    "op1_substring_dedup": substring_dedup.ORACLE,
    "op5_exact_top_k": topk.ORACLE,
    "op6_pareto_mixing": mixing.ORACLE,
    "op8_secret_scan": secret_scan.ORACLE,
    "op10_pq_near_dedup": pq.ORACLE,
    "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_collocations": collocations.ORACLE,
    "op13_window_dedup": window_dedup.ORACLE,
}
