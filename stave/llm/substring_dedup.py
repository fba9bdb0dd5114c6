"""Substring dedup by level-wise doubling of repeated word windows.

Windows start at four words; those that recur in another document are extended to twice
the length, eight, and then to the full thirteen, until no candidate survives.
The first level is taken at content-defined places only (see ``repeats``), which every
longer repeat must share; the second holds the stretches around a surviving place that a
longer repeat can share with another, and from the third on windows are told one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.repeats import Unit, remove_repeats


def cut_earlier_passages(docs: DataFrame, words: int = 13, start: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Remove each word covered by a window of ``words`` words that also starts under a smaller id.

    Returns one row per input row: id, ``n_words``, ``n_removed``, ``n_spans`` and ``kept``
    (the remaining words joined by one space). Words are ``[^\\x20\\x09-\\x0D]+``; a null or
    empty text has none. Rows of equal id never condemn each other; a null id counts as
    less than all others. Shorter texts stay whole. An empty table gives no rows. Other
    columns are ignored. Levels are ``start`` words, twice that, and so on up to ``words``.
    """
    start = min(start, words)
    lengths, length = [], 2 * start
    while length < words:
        length = min(2 * length, words)
        lengths.append(length)
    # Windows that begin within so many words of each other share twice the first length around their place.
    unit = Unit(words=True, span=words, gram=start, lengths=tuple(lengths) or (words,), segment=max(0, words - 2 * start + 1))
    out = remove_repeats(docs, unit, id_col, text_col, earlier_only=True)
    return out.withColumnRenamed("n_items", "n_words")


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = cut_earlier_passages(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
