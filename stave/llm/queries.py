"""The registered queries of this subpackage and their SQL oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from stave.llm.contextual_pii import op12_contextual_pii
from stave.llm.dart_minhash import op2_dart_minhash
from stave.llm.decontaminate import op4_decontaminate
from stave.llm.hd_language import op9_hd_language
from stave.llm.hard_negatives import op11_hard_negatives
from stave.llm.hilbert_shards import op1_hilbert_shards
from stave.llm.line_rules import op5_line_rules
from stave.llm.linked_secrets import op6_linked_secrets
from stave.llm.periodic_runs import op13_periodic_runs
from stave.llm.pieces import op3_pieces
from stave.llm.substring_dedup import op10_substring_dedup
from stave.llm.suffix_dedup import op7_suffix_dedup
from stave.llm.zip_warc import op8_zip_warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline at the repository's top."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_hilbert_shards": op1_hilbert_shards,
    "op2_dart_minhash": op2_dart_minhash,
    "op3_pieces": op3_pieces,
    "op4_decontaminate": op4_decontaminate,
    "op5_line_rules": op5_line_rules,
    "op6_linked_secrets": op6_linked_secrets,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_zip_warc": op8_zip_warc,
    "op9_hd_language": op9_hd_language,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_contextual_pii": op12_contextual_pii,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": pipeline,
}
# SQL on whole tables is too slow or cannot express the methods; tests/llm holds each query against brute force.
ORACLES: dict[str, str] = {}
