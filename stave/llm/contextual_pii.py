"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Four kinds are known by their form: e-mail and IP addresses, payment cards and telephone
numbers. They are the seeds. The words around them are patterns; patterns and the values
met in them form a graph, which is scored in rounds: a pattern is worth the share of its
values that are believed to be of a kind, a value is believed by the patterns it is met in.
Values that only look like identifiers are reported once patterns of high confidence vouch
for them, and then support patterns of their own.

Every pattern below is linear: a run of token characters is entered at its start only and
never given back, so long texts without blanks cost no more than others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stave.llm.steps import discard, step

BASE = ("email", "ip", "card", "phone")
CANDIDATE = "candidate"
# The forms of the kinds. Possessive where nothing behind could be matched by less.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    CANDIDATE: r"(?<![\p{L}0-9._@+#/-])(?:[\p{L}._@+#/-]*+[0-9]){4,}+[\p{L}0-9._@+#/-]*+",
}
#: Code points of context read on either side of a match.
CONTEXT = 48
#: Different believed values a pattern needs, the confidence asked of patterns and values, and the rounds.
SUPPORT, CONFIDENCE, ROUNDS = 5, 0.8, 4


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check sum of a digit string is a multiple of ten."""
    turned = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        digit = F.substr(turned, i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 0, 2 * digit - F.when(digit > 4, 9).otherwise(0)).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _counts(match: Column, kind: str) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda part: part.cast("double") <= 255)
    if kind == "card":
        digits = _digits(match)
        return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(match)).between(9, 15)
    return F.lit(True)


def _found(text: Column, kind: str) -> Column:
    """Of each leftmost match, in order: the gap before, its length, whether it counts, itself, and the text around it."""
    whole = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    n = F.size(whole)
    before, behind = F.slice(gaps, F.lit(1), n), F.slice(gaps, F.lit(2), n)
    all_of = F.arrays_zip(
        F.transform(before, F.length).alias("gap"), F.transform(whole, F.length).alias("len"), F.transform(whole, lambda m: _counts(m, kind)).alias("ok"),
        whole.alias("value"), F.transform(before, lambda g: F.right(g, F.lit(CONTEXT))).alias("left"), F.transform(behind, lambda g: F.left(g, F.lit(CONTEXT))).alias("right"))
    some = text.contains("@") if kind == "email" else text.contains("+") if kind == "phone" else text.rlike(PATTERNS[kind])
    return F.when(some, all_of)


def _words(text: Column) -> Column:
    """The words of a context in lower case, digits as zeros."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[0-9]", "0"), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _patterns(left: Column, right: Column) -> Column:
    """The lexical patterns of a place: two and three words before it, one before with one behind."""
    before, behind = _words(left), _words(right)

    def last(n: int) -> Column:
        return F.when(F.size(before) >= n, F.concat(F.array_join(F.slice(before, -n, n), " "), F.lit(" _")))

    return F.array_compact(F.array(last(2), last(3), F.when(F.size(behind) >= 1, F.concat(last(1), F.lit(" "), F.get(behind, 0)))))


def _spans(rows: DataFrame) -> DataFrame:
    """(_row, kind, start, end, value, patterns) of base matches, and of candidates that overlap none of them."""
    kinds = (*BASE, CANDIDATE)
    each = [rows.where(F.size(f"_{k}") > 0).select("_row", F.lit(k).alias("kind"), F.posexplode(f"_{k}").alias("i", "m")) for k in kinds]
    every = reduce(DataFrame.unionByName, each).select("_row", "kind", "i", "m.*")
    ends = every.withColumn("stop", F.expr("sum(gap + len) over (partition by _row, kind order by i)")).where("ok")
    # A stop or a dash at the end of a token is not part of the identifier.
    trimmed = F.when(F.col("kind") == CANDIDATE, F.regexp_replace("value", r"(?<![._@+#/-])[._@+#/-]++$", "")).otherwise(F.col("value"))
    start = F.col("stop") - F.col("len")
    spans = ends.select("_row", "kind", start.alias("start"), (start + F.length(trimmed)).alias("end"), F.lower(trimmed).alias("value"), _patterns(F.col("left"), F.col("right")).alias("patterns"))
    base = f"kind <> '{CANDIDATE}'"
    rows_before = "rows between unbounded preceding and 1 preceding"
    spans = spans.withColumn("reach", F.expr(f"max(if({base}, end, null)) over (partition by _row order by start, {base} desc {rows_before})"))
    spans = spans.withColumn("next", F.expr(f"min(if({base}, start, null)) over (partition by _row order by start desc, {base} {rows_before})"))
    free = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.coalesce("next", F.col("end")) >= F.col("end"))
    return spans.where(F.expr(base) | free).drop("reach", "next")


def bootstrap(spans: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, seeds: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (value, kind, belief): the accepted patterns and the values found by them.

    The graph has an edge for each pattern and each different value met in it, however often.
    A pattern's confidence in a kind is the sum of its values' beliefs over their number plus
    one; it is accepted with ``support`` values believed at ``confidence`` or more, and a
    confidence that high itself. A value that is no seed is believed by all its accepted
    patterns together: 1 minus the product of their doubts. Rounds end when nothing is found any more.
    """
    seeded = spans.where(F.col("kind") != CANDIDATE).select("value", "kind")
    if seeds is not None:
        seeded = seeded.unionByName(seeds.select(F.lower("value").alias("value"), F.col("kind").cast("string").alias("kind")).where("value IS NOT NULL AND kind IS NOT NULL"))
    seeded = step(seeded.distinct().withColumn("belief", F.lit(1.0)), "seeds")
    edges = spans.select(F.explode("patterns").alias("pattern"), "value").distinct()
    sizes = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support)
    edges = step(edges.join(sizes, "pattern"), "pattern_graph")
    found, known, written = seeded.limit(0), None, [edges]
    for _ in range(rounds):
        believed = seeded.unionByName(found)
        hits = edges.join(believed, "value").groupBy("pattern", "kind", "n").agg(F.sum("belief").alias("s"), F.count_if(F.col("belief") >= confidence).alias("believed"))
        hits = hits.withColumn("confidence", F.col("s") / (F.col("n") + 1))
        patterns = step(hits.where((F.col("believed") >= support) & (F.col("confidence") >= confidence)).select("pattern", "kind", "confidence"), "patterns")
        doubts = edges.join(patterns, "pattern").join(seeded.select("value"), "value", "left_anti").groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("belief"))
        best = doubts.where(F.col("belief") >= confidence).groupBy("value").agg(F.max(F.struct("belief", "kind")).alias("b"))
        found = step(best.select("value", "b.kind", "b.belief"), "found")
        written += [patterns, found]
        now = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("value", "kind").cast("decimal(38,0)")).alias("h")).first()
        if known == tuple(now):
            break
        known = tuple(now)
    discard(*(x for x in written if x is not patterns and x is not found), seeded)
    return patterns, found


def scan_personal_data(docs: DataFrame, support: int = SUPPORT, confidence: float = CONFIDENCE, rounds: int = ROUNDS, seeds: DataFrame | None = None,
                       id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``found``, an array of (start, end, kind) by start, then kind.

    Starts and ends count code points of the whole text, ends exclusive. The base kinds
    ``email``, ``ip``, ``card`` and ``phone`` come first in order; matches of one kind do not
    overlap, those of different kinds may. Identifiers that only their context tells are of
    kind ``contextual_`` and the kind; they are tokens with four or more digits that overlap no
    base match, and every occurrence of such a value is reported. ``seeds`` may add known
    (value, kind) rows of any kind.

    Null and empty texts have none; repeated rows are scanned one by one and count their
    values once; of several kinds for one value the most believed wins, then the last in
    order. A null id is kept; an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), *(_found(text, k).alias(f"_{k}") for k in (*BASE, CANDIDATE)), F.monotonically_increasing_id().alias("_row"))
    rows = step(rows, "matches")
    spans = step(_spans(rows), "spans")
    _, found = bootstrap(spans, support, confidence, rounds, seeds)
    candidates = spans.where(F.col("kind") == CANDIDATE).drop("kind").join(found.select("value", F.concat(F.lit("contextual_"), "kind").alias("kind")), "value")
    kept = spans.where(F.col("kind") != CANDIDATE).select("_row", "start", "end", "kind").unionByName(candidates.select("_row", "start", "end", "kind"))
    order = F.array_position(F.array(*map(F.lit, BASE)), F.col("kind"))
    order = F.when(order > 0, order).otherwise(len(BASE) + 1)
    lists = kept.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", order.alias("o"), "kind", "end"))).alias("found"))
    none = F.array().cast("array<struct<start:bigint,o:bigint,kind:string,end:bigint>>")
    told = F.transform(F.coalesce("found", none), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return rows.select("_id", "_row").join(lists, "_row", "left").select(F.col("_id").alias(id_col), told.alias("found"))


def _told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_contextual_pii(spark, sf_dir: str) -> DataFrame:
    out = scan_personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*BASE))
    return out.select("doc_id", *(count(k) for k in BASE), F.sha2(_told(base).cast("binary"), 256).alias("base_sha256"), _told(F.col("found")).alias("spans"))
