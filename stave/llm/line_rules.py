"""Quality rules with cross-document line frequency.

Lines are normalised and hashed, and the different documents of one host that hold a
line are counted. Lines above the host's limit are boilerplate and go; a document that
loses too many of its words with them is rejected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.llm.dart_minhash import _LOWER
from stave.llm.rolling import Rolling, byte_rolling, documents, word_bounds, word_hashes
from stave.llm.steps import step

MIN_WORDS = 50
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _later(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether (row, value) occurred at an earlier place."""
    order = np.lexsort((value, row))
    same = np.zeros(len(row), bool)
    same[order[1:]] = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    return same


def _again(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether (row, value) occurs at another place."""
    order = np.lexsort((value, row))
    twin = (row[order[1:]] == row[order[:-1]]) & (value[order[1:]] == value[order[:-1]])
    both = np.zeros(len(row), bool)
    both[order[1:]] |= twin
    both[order[:-1]] |= twin
    return both


def measure(raw: np.ndarray, bounds: np.ndarray) -> tuple[dict[str, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The measures of each row, and (row, hash, words) of its normalised lines, equal lines together."""
    rows = len(bounds) - 1
    starts, ends, at = word_bounds(raw, bounds)
    who = np.repeat(np.arange(rows), np.diff(at))
    heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    chars = np.concatenate([[0], np.cumsum(heads[ends] - heads[starts])])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[raw])])
    out = {"n_words": np.diff(at), "word_chars": chars[at[1:]] - chars[at[:-1]], "n_symbols": symbols[bounds[1:]] - symbols[bounds[:-1]]}

    breaks = np.flatnonzero(raw == 0x0A) + 1
    line_start = np.unique(np.concatenate([bounds, breaks]))
    line_end = np.append(line_start[1:], len(raw))
    cut = np.isin(line_end, breaks) & (line_end > line_start)
    line_end = line_end - cut
    line = np.searchsorted(line_start, starts, "right") - 1
    new = np.ones(len(line), bool)
    new[1:] = line[1:] != line[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(line))
    owner = who[first]
    exact = byte_rolling(raw).stretch(line_start[line[first]], line_end[line[first]])
    out["n_dup_lines"] = np.bincount(owner[_later(owner, exact)], minlength=rows)

    grams = Rolling(word_hashes(raw, starts, ends), "word").grams(3)
    inside = np.flatnonzero(who[: len(grams)] == who[len(who) - len(grams):])
    twice = inside[_again(who[inside], grams[inside])]
    covered = np.zeros(len(who), bool)
    for i in range(3):
        covered[twice + i] = True
    out["n_repeat_words"] = np.bincount(who[covered], minlength=rows)

    low = _LOWER[raw]
    normal = Rolling(word_hashes(low, starts, ends), "word").stretch(first, last)
    order = np.lexsort((normal, owner))
    owner, normal, size = owner[order], normal[order], (last - first)[order]
    lead = np.ones(len(owner), bool)
    lead[1:] = (owner[1:] != owner[:-1]) | (normal[1:] != normal[:-1])
    lead = np.flatnonzero(lead)
    words = np.add.reduceat(size, lead) if len(lead) else size
    return out, (owner[lead], normal[lead], words)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, raw, bounds in documents(batch, "_text"):
            values, (owner, line, words) = measure(raw, bounds)
            edges = pa.array(np.searchsorted(owner, np.arange(b - a + 1)).astype(np.int32))
            lines = pa.ListArray.from_arrays(edges, pa.StructArray.from_arrays([pa.array(line.view(np.int64)), pa.array(words.astype(np.int32))], ["h", "n"]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(n).slice(a, b - a) for n in ("_id", "_host", "_k")] + [pa.array(values[m].astype(np.int64)) for m in MEASURES] + [lines],
                ["_id", "_host", "_k", *MEASURES, "_lines"])


def judge_lines(docs: DataFrame, least: int = 20, share: float = 0.005, depleted: float = 0.5, most: int = 100, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per input row: id, the measures, ``n_removed_lines``, ``n_removed_words``, ``base_failed`` and ``kept``.

    A line (its words in lower case, blanks as one) is boilerplate where more than
    ``least`` different texts of its host hold it, and more than ``share`` of the host's
    texts, or more than ``most`` of them, so that the limit does not grow with the host
    beyond that. Equal texts of a host count as one document, however often a line occurs in a
    text. Kept is a row that passes the base rules and loses at most ``depleted`` of its words.
    Null and empty texts have no words and fail; a null host is a host of its own; repeated
    rows are judged alike; a null id stays null. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(host_col).cast("string"), F.lit("\0")).alias("_host"), F.unhex(F.md5(text)).alias("_k"), text.alias("_text"))
    kind = f"_id {dict(rows.dtypes)['_id']}, _host string, _k binary, {', '.join(f'{m} long' for m in MEASURES)}, _lines array<struct<h:bigint,n:int>>"
    rows = step(rows.mapInArrow(_measured, kind).withColumn("_row", F.monotonically_increasing_id()), "measured")
    texts = rows.groupBy("_host", "_k").agg(F.first("_lines").alias("_lines"))
    hosts = rows.select("_host", "_k").distinct().groupBy("_host").agg(F.count(F.lit(1)).alias("_texts"))
    counts = texts.select("_host", F.explode("_lines.h").alias("h")).groupBy("_host", "h").agg(F.count(F.lit(1)).alias("_in")).where(F.col("_in") > least)
    common = step(counts.join(hosts, "_host").where(F.col("_in") > F.least(share * F.col("_texts"), F.lit(float(most)))).select("_host", "h"), "common_lines")
    lines = rows.select("_row", "_host", F.explode("_lines").alias("l")).select("_row", "_host", "l.h", "l.n")
    lost = lines.join(common, ["_host", "h"], "left_semi").groupBy("_row").agg(F.count(F.lit(1)).alias("n_removed_lines"), F.sum("n").alias("n_removed_words"))
    out = rows.drop("_lines").join(lost, "_row", "left").withColumns({n: F.coalesce(n, F.lit(0)).cast("long") for n in ("n_removed_lines", "n_removed_words")})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.select(F.col("_id").alias(id_col), *MEASURES, "n_removed_lines", "n_removed_words", failed.alias("base_failed"),
                      (~failed & (F.col("n_removed_words") <= depleted * F.col("n_words"))).alias("kept"))


def op5_line_rules(spark, sf_dir: str) -> DataFrame:
    return judge_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
