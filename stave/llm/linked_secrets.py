"""Secret scans with multipart credential linking, in DataFrame operations only.

Strong spans stand alone: assigned secrets, access identifiers, long hexadecimal runs.
Bare keys and endpoints are weak: they are reported only where a complementary part
starts within the same scope, which an interval join on bins of the scope's width finds.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.llm.repeats import NULL_ID
from stave.llm.steps import step

SCOPE = 300
# The patterns of the kinds, and the kinds in their order.
KINDS = ("assign", "access", "hex", "key", "endpoint")
PATTERNS = {
    "assign": "((?i:password|passwd|secret|token|api_?key))[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]{24,}",
    "key": "[A-Za-z0-9+/=_-]{32,}",
    "endpoint": "https?://[A-Za-z0-9.-]+[^\\x20\\x09-\\x0D\"'<>]*",
}
#: The strong kinds that complete a weak one.
PARTNERS = {"key": ("access",), "endpoint": ("access", "assign")}


def _found(text: Column, kind: str) -> Column:
    """(gap before, length, whether it counts) of each leftmost match, in order."""
    pattern = F.lit(PATTERNS[kind])
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    if kind == "assign":
        counts = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda g: F.length(g) >= 6)
    elif kind == "access":
        counts = F.transform(whole, lambda m: F.length(m) >= 20)
    elif kind == "key":
        counts = F.transform(whole, lambda m: m.rlike("[0-9]") & m.rlike("[a-z]") & m.rlike("[A-Z]"))
    else:
        counts = F.transform(whole, lambda m: F.lit(True))
    sizes = F.arrays_zip(F.transform(F.slice(gaps, 1, F.size(whole)), F.length).alias("gap"), F.transform(whole, F.length).alias("len"), counts.alias("ok"))
    some = {"access": text.contains("AKIA"), "endpoint": text.contains("://")}.get(kind, text.rlike(PATTERNS[kind]))
    return F.when(some, sizes)


def _spans(rows: DataFrame) -> DataFrame:
    """(_row, kind, start, end) of all counting matches, in code points."""
    each = [rows.where(F.size(f"_{k}") > 0).select("_row", F.lit(k).alias("kind"), F.posexplode(f"_{k}").alias("i", "m")) for k in KINDS]
    every = reduce(DataFrame.unionByName, each).select("_row", "kind", "i", "m.gap", "m.len", "m.ok")
    ends = every.withColumn("end", F.expr("sum(gap + len) over (partition by _row, kind order by i)"))
    return ends.where("ok").select("_row", "kind", (F.col("end") - F.col("len")).alias("start"), "end")


def _linked(spans: DataFrame, scope: int) -> DataFrame:
    """The weak spans with a partner that starts within ``scope`` code points.

    Of each row, kind and bin only the first and last start are joined, so no pairs within
    a scope are made: a partner is near if it is the last of the bin before, any of the same
    bin, or the first of the bin behind.
    """
    place = F.floor(F.col("start") / scope)
    strong = spans.where(F.col("kind").isin("access", "assign")).groupBy("_row", F.col("kind").alias("partner"), place.alias("bin"))
    strong = strong.agg(F.min("start").alias("first"), F.max("start").alias("last"))
    pairs = F.create_map(*(x for k, v in PARTNERS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    weak = spans.where(F.col("kind").isin(*PARTNERS)).withColumn("partner", F.explode(pairs[F.col("kind")]))
    weak = weak.withColumn("bin", F.explode(F.array(place - 1, place, place + 1)))
    own = F.floor(F.col("start") / scope)
    near = F.when(F.col("bin") < own, F.col("last") >= F.col("start") - scope).when(F.col("bin") > own, F.col("first") <= F.col("start") + scope).otherwise(True)
    return weak.join(strong, ["_row", "partner", "bin"]).where(near).select("_row", "kind", "start", "end").distinct()


def scan_secrets(docs: DataFrame, scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, ``_tag`` (hash of the text) and ``secrets``: array of (start, end, kind) by start, then kind.

    Starts and ends count code points of the whole text, ends exclusive. Matches of one
    kind do not overlap, those of different kinds may. Null and empty texts have none;
    repeated rows are scanned one by one. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), F.xxhash64(text).alias("_tag"), *(_found(text, k).alias(f"_{k}") for k in KINDS), F.monotonically_increasing_id().alias("_row"))
    rows = step(rows, "matches")
    spans = step(_spans(rows), "spans")
    kept = spans.where(~F.col("kind").isin(*PARTNERS)).unionByName(_linked(spans, scope))
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    lists = kept.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "end", "kind"))).alias("secrets"))
    return rows.select("_id", "_tag", "_row").join(lists, "_row", "left").select(
        F.col("_id").alias(id_col), "_tag", F.transform(F.coalesce("secrets", F.array().cast("array<struct<start:bigint,o:bigint,end:bigint,kind:string>>")),
                                                       lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("secrets"))


def redact(docs: DataFrame, mask: str = "[secret]", scope: int = SCOPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with each reported span of the text replaced by ``mask``; spans that touch or overlap become one.

    Rows without secrets, null texts and the other columns stay as they are.
    """
    found = scan_secrets(docs, scope, id_col, text_col).where(F.size("secrets") > 0)
    found = found.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("_d"), "_tag", "secrets").dropDuplicates(["_d", "_tag"])
    each = found.select("_d", "_tag", F.explode("secrets").alias("s")).select("_d", "_tag", "s.start", "s.end")
    # A gap lies before each span that starts behind all earlier ends.
    gaps = each.withColumn("reach", F.expr("coalesce(max(end) over (partition by _d, _tag order by start, end rows between unbounded preceding and 1 preceding), -1)"))
    gaps = gaps.groupBy("_d", "_tag").agg(F.sort_array(F.collect_list(F.when(F.col("start") > F.col("reach"), F.struct(F.greatest("reach", F.lit(0)).alias("a"), F.col("start").alias("b"))))).alias("_gaps"), F.max("end").alias("_end"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.withColumns({"_d": F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)), "_tag": F.xxhash64(text)})
    both = keyed.join(gaps.hint("shuffle_hash"), ["_d", "_tag"], "left")
    parts = F.transform("_gaps", lambda g: F.substring(F.col(text_col), (g["a"] + 1).cast("int"), (g["b"] - g["a"]).cast("int")))
    behind = F.expr(f"substring(`{text_col}`, cast(_end + 1 as int))")
    masked = F.concat(F.array_join(parts, mask), F.lit(mask), behind)
    return both.withColumn(text_col, F.when(F.col("_gaps").isNull(), F.col(text_col)).otherwise(masked)).select(*docs.columns)


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op6_linked_secrets(spark, sf_dir: str) -> DataFrame:
    out = scan_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("secrets", lambda s: s["kind"].isin("assign", "access", "hex"))
    return out.select("doc_id", *(count(k) for k in KINDS), F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("secrets")).alias("spans"))
