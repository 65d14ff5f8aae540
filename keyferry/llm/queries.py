"""The registered queries of this subpackage and the SQL twins of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keyferry.llm.bpe import op1_byte_bpe
from keyferry.llm.decontaminate import OP2_SQL, op2_benchmark_winnowing
from keyferry.llm.simhash import op7_simhash_golay
from keyferry.llm.secrets import OP8_SQL, op8_credential_links
from keyferry.llm.langid import op3_ppm_language
from keyferry.llm.quality import op4_byte_cnn_quality
from keyferry.llm.chat import OP5_SQL, op5_prefix_targets
from keyferry.llm.neighbours import op6_learned_partitions
from keyferry.llm.suffixes import OP9_SQL, op9_sparse_suffixes
from keyferry.llm.chains import op10_collinear_chains
from keyferry.llm.caps import OP11_SQL, op11_cap_filters
from keyferry.llm.centroids import OP12_SQL, op12_bisector_tournament
from keyferry.llm.lexical import OP13_SQL, op13_shared_terms

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_benchmark_winnowing": op2_benchmark_winnowing,
    "op7_simhash_golay": op7_simhash_golay,
    "op8_credential_links": op8_credential_links,
    "op3_ppm_language": op3_ppm_language,
    "op4_byte_cnn_quality": op4_byte_cnn_quality,
    "op5_prefix_targets": op5_prefix_targets,
    "op6_learned_partitions": op6_learned_partitions,
    "op9_sparse_suffixes": op9_sparse_suffixes,
    "op10_collinear_chains": op10_collinear_chains,
    "op11_cap_filters": op11_cap_filters,
    "op12_bisector_tournament": op12_bisector_tournament,
    "op13_shared_terms": op13_shared_terms,
}

ORACLES: dict[str, str] = {
    "op2_benchmark_winnowing": OP2_SQL,
    "op8_credential_links": OP8_SQL,
    "op5_prefix_targets": OP5_SQL,
    "op9_sparse_suffixes": OP9_SQL,
    "op11_cap_filters": OP11_SQL,
    "op12_bisector_tournament": OP12_SQL,
    "op13_shared_terms": OP13_SQL,
}
