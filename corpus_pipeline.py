"""A corpus pipeline of five stages over the documents table, each of one operator of ``stave.llm``.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
``run`` writes every stage's rows to the shared folder and starts the next from them, so a
lost executor costs at most the tasks of one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stave.llm.dart_minhash import near_duplicate_classes
from stave.llm.decontaminate import leaks
from stave.llm.hd_language import held_out, identify, profiles
from stave.llm.linked_secrets import redact
from stave.llm.pieces import MODEL_PATH, encoded, load_pieces
from stave.llm.repeats import NULL_ID
from stave.llm.steps import step

#: More signs than in op9: chance gives a cosine of about 1 / sqrt(1024) = 0.03.
SIGNS = 1024
#: A text is far from every language below this quantile of the learned texts with as many letters.
FAR = 0.005
#: Learned texts are also cut to so many characters. Quantiles come of so many pieces at least.
CUTS, LEAST = (20, 40, 80, 160, 320, 640, 1280, 2560), 100


def _letters():
    """The number of letters of a text as a power of two, rounded down; null without any."""
    return F.floor(F.log2(F.length(F.regexp_replace("text", r"\P{L}+", "")))).cast("int")


def floors(learned: DataFrame, known: dict[str, list[int]]) -> dict[int, float]:
    """For each power of two of letters the least score of a text in a known language.

    It is a low quantile of the scores of all learned texts and their beginnings that are told
    as their own language, so that of clean texts of any length about as many fall below.
    A size with too few of them is left out.
    """
    named = learned.where(F.col("lang").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    cuts = F.array(F.col("text"), *(F.when(F.length("text") > n, F.substring("text", 1, n)) for n in CUTS))
    pieces = named.select("lang", F.explode(cuts).alias("text")).where("text IS NOT NULL")
    told = identify(pieces, known, dimensions=SIGNS).where("lang_pred = lang").groupBy(_letters().alias("size"))
    rows = told.agg(F.percentile_approx("score", FAR, 10_000).alias("floor"), F.count(F.lit(1)).alias("n")).where((F.col("n") >= LEAST) & F.col("size").isNotNull())
    return {r["size"]: r["floor"] for r in rows.collect()}


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters and those far from every language.

    Far is told by the learned texts of the same size (``floors``), or of the next smaller
    size learned; a text shorter than any of these stays, since too little of it is there to tell.
    """
    learned = docs.where(~held_out())
    known = profiles(learned, dimensions=SIGNS)
    least = floors(learned, known)
    table = [least[max(smaller)] if (smaller := [x for x in least if x <= size]) else 0.0 for size in range(32)]
    floor = F.coalesce(F.get(F.array(*map(F.lit, table)), _letters()), F.lit(0.0))
    told = identify(docs, known, dimensions=SIGNS).where((F.col("lang_pred") != "und") & (F.col("score") >= floor))
    return told.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of near-duplicates: that of the smallest id, once."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = {"_d": F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), "_tag": F.xxhash64(text)}
    first = near_duplicate_classes(docs, tag_col="_tag").where("is_first").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_d"), "_tag").distinct()
    kept = docs.withColumns(keys).join(first.hint("shuffle_hash"), ["_d", "_tag"], "left_semi")
    once = F.row_number().over(Window.partitionBy("_d", "_tag").orderBy("_tag"))
    return kept.withColumn("_once", once).where("_once = 1").select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark, each by its id and text."""
    found = leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), tag_col="_tag").select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_d"), "_tag").distinct()
    keys = {"_d": F.coalesce(F.col("doc_id"), F.lit(NULL_ID)), "_tag": F.xxhash64(F.coalesce(F.col("text"), F.lit("")))}
    return docs.withColumns(keys).join(found, ["_d", "_tag"], "left_anti").select(*docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts by a mask, and count the characters anew."""
    return redact(docs).withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each text, and whether decoding gives the text back."""
    return encoded(docs, load_pieces(MODEL_PATH), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_secrets", mask_secrets),
    ("to_pieces", to_pieces),
]

#: Signatures, walks and vectors of signs are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = step(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
