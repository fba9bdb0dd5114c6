"""Suffix-array dedup: cut every passage of a given length that occurs more than once.

Suffixes are told apart only through their first ``threshold`` bytes, by most-significant
digit passes of 150 bytes each (the last of 100): a pass splits every group by the next digit, groups of one
leave, and groups that are equal through the threshold are exactly the repeated windows.
Which group a suffix is in matters, not the order of the groups, so digits are compared by
64-bit hashes. The first digit is a content-defined gram that stands for all suffixes
around it (see ``repeats``), so its pass shuffles about one row per 125 bytes; suffixes
are listed one by one only where a group is still undecided.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.repeats import Unit, remove_repeats


def cut_repeated_bytes(docs: DataFrame, threshold: int = 400, digit: int = 150, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each byte covered by a ``threshold``-byte string that also starts anywhere else.

    Returns one row per input row: id, ``n_bytes``, ``n_removed``, ``n_spans`` (maximal
    removed runs) and ``kept`` (binary). Texts are UTF-8 bytes; a null or empty text has
    none. Matches never cross rows; repeated rows repeat each other's strings, overlapping
    occurrences inside one text count. Texts below the threshold stay whole. A null id is
    kept; other columns are ignored.
    """
    digit = min(digit, threshold)
    unit = Unit(words=False, span=threshold, gram=digit, lengths=(*range(2 * digit, threshold, digit), threshold), segment=max(1, (threshold - digit) // 8))
    out = remove_repeats(docs, unit, id_col, text_col, earlier_only=False)
    return out.withColumnRenamed("n_items", "n_bytes")


def op7_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = cut_repeated_bytes(docs)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
