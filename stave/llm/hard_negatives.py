"""Hard-negative mining by slots: one search per anchor serves the windows of all its positives.

A negative of a positive with score s lies in a window of scores up to a share of s.
The upper limits of an anchor's positives, in descending order, split the scores into
disjoint slots, so a candidate belongs to one slot however many windows overlap there.
Each task keeps the best few of each slot (a combiner), Spark keeps the best few of all
tasks, and the window of a positive is answered by its slot and those below, merged in
descending order.

Rows and anchors meet in cells of bounded size: rows are dealt into blocks, anchors into
blocks, and each pair of blocks is one group of its own. No label, vector or id decides
where a row goes, so none can be a hot key.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stave.llm.steps import step

#: Most rows and anchors of one cell, rows that are worth a cell, and rows and anchors compared at a time in one.
ROW_BLOCK, ANCHOR_BLOCK, LEAST_BLOCK = 65_536, 16_384, 4_096
PART, ANCHORS_AT_ONCE = 1_024, 512
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1
_PAIR = "a_key long, slot int, other_id long, score long"


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The flat components, in whole 256ths, and the bounds of the vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    bounds = np.asarray(column.offsets).astype(np.int64)
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)[bounds[0]: bounds[-1]]
    with np.errstate(over="ignore"):
        quantised = np.floor(256.0 * flat)
    return np.clip(quantised, -np.finfo(np.float64).max, np.finfo(np.float64).max), bounds - bounds[0]


def scores(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-number vectors; one beyond a long counts as the nearest long."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(left.shape[1], 1)
    if most < 2.0 ** 24:
        return (left.astype(np.float32) @ right.T.astype(np.float32)).astype(np.int64)
    if most < 2.0 ** 53:
        return (left @ right.T).astype(np.int64)
    whole = np.frompyfunc(int, 1, 1)
    exact = whole(left).astype(object) @ whole(right).T.astype(object)
    return np.clip(exact, _LEAST, _MOST).astype(np.int64)


class _Best:
    """The best k of each (anchor, slot): highest score, then smallest id, a null id last."""

    def __init__(self, groups: int, k: int):
        self.k, self.floor = k, np.full(groups, _LEAST, np.int64)
        self.group, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.id, self.null = np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, group: np.ndarray, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        if not len(group):
            return
        group, score = np.concatenate([self.group, group]), np.concatenate([self.score, score])
        ids, null = np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        order = np.lexsort((ids, null, ~score, group))
        group = group[order]
        lead = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        turn = np.arange(len(group)) - np.repeat(lead, np.diff(np.append(lead, len(group))))
        kept = order[turn < self.k]
        last = turn == self.k - 1
        self.floor[group[last]] = score[order[last]]
        self.group, self.score, self.id, self.null = group[turn < self.k], score[kept], ids[kept], null[kept]


def _cell(k: int, same: bool) -> Callable:
    """The best k of each anchor and slot among the rows of a cell, with the anchor's label or another one."""

    def run(key: tuple, rows: pa.Table, anchors: pa.Table) -> pa.Table:
        schema = pa.schema([("a_key", pa.int64()), ("slot", pa.int32()), ("other_id", pa.int64()), ("score", pa.int64())])
        if not len(rows) or not len(anchors):
            return schema.empty_table()
        flat, bounds = _matrix(rows.column("vec"))
        aflat, abounds = _matrix(anchors.column("a_vec"))
        ids, labels = rows.column("id"), rows.column("label").to_numpy()
        null, ids = ids.is_null().to_numpy(), ids.fill_null(0).to_numpy()
        aids, alabels, akeys = anchors.column("a_id"), anchors.column("a_label").to_numpy(), anchors.column("a_key").to_numpy()
        anull, aids = aids.is_null().to_numpy(), aids.fill_null(0).to_numpy()
        limits = anchors.column("limits").combine_chunks()
        starts, low, high = np.asarray(limits.offsets).astype(np.int64), *(limits.values.field(n).to_numpy() for n in ("low", "high"))
        out = []
        for size in np.intersect1d(np.diff(bounds), np.diff(abounds)):
            mine, wanted = np.flatnonzero(np.diff(bounds) == size), np.flatnonzero(np.diff(abounds) == size)
            vectors = flat[bounds[mine][:, None] + np.arange(size)]
            for kind in (np.intersect1d(labels[mine], alabels[wanted]) if same else (None,)):
                some, those = (mine[labels[mine] == kind], wanted[alabels[wanted] == kind]) if same else (mine, wanted)
                block = vectors if not same else vectors[labels[mine] == kind]
                for at in range(0, len(those), ANCHORS_AT_ONCE):
                    who = those[at: at + ANCHORS_AT_ONCE]
                    avec = aflat[abounds[who][:, None] + np.arange(size)]
                    slots = int(np.diff(starts)[who].max(initial=0))
                    if not slots:
                        continue
                    # Slot j of an anchor holds the scores from bottom to top; a missing slot holds none.
                    top, bottom = np.full((len(who), slots), _LEAST, np.int64), np.full((len(who), slots), _MOST, np.int64)
                    for j in range(slots):
                        there = starts[who] + j < starts[who + 1]
                        place = (starts[who] + j)[there]
                        top[there, j], bottom[there, j] = high[place], low[place]
                    best = _Best(len(who) * slots, k)
                    for row in range(0, len(some), PART):
                        part = some[row: row + PART]
                        table = scores(avec, block[row: row + PART])
                        ok = (aids[who][:, None] != ids[part]) | anull[who][:, None] | null[part]
                        if not same:
                            ok &= alabels[who][:, None] != labels[part]
                        for j in range(slots):
                            floor = np.maximum(bottom[:, j], best.floor.reshape(len(who), slots)[:, j])
                            hit, other = np.nonzero(ok & (table >= floor[:, None]) & (table <= top[:, j][:, None]))
                            best.add(hit * slots + j, table[hit, other], ids[part[other]], null[part[other]])
                    out.append(pa.Table.from_arrays([
                        pa.array(akeys[who[best.group // slots]]), pa.array((best.group % slots).astype(np.int32)),
                        pa.array(best.id, mask=best.null), pa.array(best.score)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def _best_of_all(rows: DataFrame, anchors: DataFrame, cells: tuple[int, int], k: int, same: bool) -> DataFrame:
    """(a_key, slot, other_id, score, place) of the best k rows of each anchor and slot."""
    blocks, parts = cells
    left = rows.select(F.pmod("key", F.lit(blocks)).alias("p"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("q"), "id", "label", "vec")
    right = anchors.select(F.explode(F.expr(f"sequence(0L, {blocks - 1}L)")).alias("p"), F.pmod("a_key", F.lit(parts)).cast("int").alias("q"),
                           "a_key", "a_id", "a_label", "a_vec", "limits")
    found = left.groupBy("p", "q").cogroup(right.groupBy("p", "q")).applyInArrow(_cell(k, same), _PAIR)
    place = F.expr("row_number() over (partition by a_key, slot order by score desc, other_id asc nulls last)")
    return found.withColumn("place", place).where(F.col("place") <= k)


def mine_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
                   id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the hard negatives.

    Components count in whole 256ths, rounded down, and a score is the exact inner product
    of two rows (beyond a long: the nearest long). The positives of an anchor (``is_anchor``,
    a condition on the columns of ``vectors``) are the first ``positives`` rows of its label
    and another id; the negatives of a positive with score s the first ``negatives`` rows of
    other labels and ids whose score is between ``low`` and ``high`` hundredths of s.
    Higher scores come first, then smaller ids; a null id comes last and is another id than
    all. An anchor without positives, or a positive without negatives, has no row.

    Rows with a null label or vector, or a null or non-finite component, take no part;
    vectors are compared with those of their own length, empty ones score 0. Repeated rows
    are rows of their own, so a repeated anchor repeats its results. A label that is not a
    number counts by its 64-bit hash. An empty table gives no rows; further columns, of any
    name, are ignored.
    """
    label = F.col(label_col).cast("long") if isinstance(vectors.schema[label_col].dataType, T.IntegralType) else F.when(F.col(label_col).isNotNull(), F.xxhash64(F.col(label_col).cast("string")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.alias("label"), F.col(vector_col).alias("vec"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("label IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(F.forall("vec", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False))))
    rows = step(rows.withColumn("key", F.monotonically_increasing_id()), "vectors")
    many = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("anchor").alias("anchors")).first()
    # Small blocks spread the work; anchors move once for each, so no more of them than keep that below the rows.
    spread = min(-(-many["rows"] // LEAST_BLOCK), many["rows"] // max(many["anchors"], 1))
    cells = max(1, -(-many["rows"] // ROW_BLOCK), spread), max(1, -(-many["anchors"] // ANCHOR_BLOCK))
    anchors = rows.where("anchor").select(F.col("key").alias("a_key"), F.col("id").alias("a_id"), F.col("label").alias("a_label"), F.col("vec").alias("a_vec"))
    every = F.array(F.struct(F.lit(_LEAST).alias("low"), F.lit(_MOST).alias("high")))
    found = step(_best_of_all(rows, anchors.withColumn("limits", every), cells, positives, True), "positives")

    # A window is empty where its least score is above its greatest.
    windows = found.select("a_key", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), "place",
                           F.expr(f"cast(ceil(score * cast({low} as decimal(10)) / 100) as long)").alias("from_score"),
                           F.expr(f"cast(floor(score * cast({high} as decimal(10)) / 100) as long)").alias("to_score")).where("from_score <= to_score")
    slots = windows.groupBy("a_key", "to_score").agg(F.min("from_score").alias("from_score"))
    slots = slots.groupBy("a_key").agg(F.sort_array(F.collect_list(F.struct(F.col("to_score").alias("high"), F.col("from_score").alias("least"))), asc=False).alias("tops"))
    below = F.transform("tops", lambda t, j: F.struct(F.greatest(t["least"], F.coalesce(F.get(F.col("tops"), j + 1)["high"] + 1, t["least"])).alias("low"), t["high"].alias("high")))
    asked = anchors.join(slots.select("a_key", "tops", below.alias("limits")), "a_key")
    kept = step(_best_of_all(rows, asked.drop("tops"), cells, negatives, False), "negatives")

    # At most (positives x negatives) candidates an anchor.
    lists = kept.groupBy("a_key").agg(F.sort_array(F.collect_list(F.struct((-F.col("score").cast("decimal(20)")).alias("o"), F.col("other_id").isNull().alias("n"), F.col("other_id").alias("id"), "slot", "score"))).alias("found"))
    merged = windows.join(slots, "a_key").join(lists, "a_key").join(anchors.select("a_key", F.col("a_id").alias("anchor_id")), "a_key")
    first = F.array_position(F.transform("tops", lambda t: t["high"]), F.col("to_score")) - 1
    mine = F.filter("found", lambda x: (x["slot"] >= first) & (x["score"] >= F.col("from_score")))
    answer = merged.select("anchor_id", "positive_id", "positive_score", F.posexplode(F.slice(mine, 1, negatives)).alias("i", "x"))
    return answer.select("anchor_id", "positive_id", (F.col("i") + 1).alias("rank"), F.col("x.id").alias("negative_id"), "positive_score", F.col("x.score").alias("negative_score"))


def op11_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)
