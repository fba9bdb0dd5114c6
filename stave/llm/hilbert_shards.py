"""Sharding by Hilbert order: rows close in several metadata dimensions share a shard.

Dimensions are quantised to a grid, cells are ranked along the Hilbert curve, and the
order is cut into runs of equal length. Only counts of grid cells are ordered globally:
a table whose size depends on the grid, not on the rows. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stave.llm.steps import step

SHARDS = 24
BITS = 3
SALTS = 8


def hilbert_index(df: DataFrame, axes: list[str], bits: int, out: str) -> DataFrame:
    """Adds the place along the Hilbert curve of grid coordinates of ``bits`` bits each.

    From the highest bit down, a quadrant's reflection or axis swap is undone, and the
    bits of the results, Gray-decoded, are the place.
    """
    names = [f"_x{i}" for i in range(len(axes))]
    df = df.withColumns({n: F.col(a).cast("long") for n, a in zip(names, axes)})
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for n in names:
            head, x = F.col(names[0]), F.col(n)
            on = F.shiftright(x, b).bitwiseAND(1) == 1
            differ = head.bitwiseXOR(x).bitwiseAND(low)
            if n == names[0]:
                df = df.withColumn(n, F.when(on, x.bitwiseXOR(F.lit(low))).otherwise(x))
            else:
                df = df.withColumns({names[0]: F.when(on, head.bitwiseXOR(F.lit(low))).otherwise(head.bitwiseXOR(differ)), n: F.when(on, x).otherwise(x.bitwiseXOR(differ))})
    for before, n in zip(names, names[1:]):
        df = df.withColumn(n, F.col(n).bitwiseXOR(F.col(before)))
    turn: Column = F.lit(0).cast("long")
    for b in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.shiftright(names[-1], b).bitwiseAND(1) == 1, F.lit((1 << b) - 1)).otherwise(F.lit(0)))
    df = df.withColumn("_turn", turn)
    place: Column = F.lit(0).cast("long")
    for b in range(bits - 1, -1, -1):
        for n in names:
            place = place * 2 + F.shiftright(F.col(n).bitwiseXOR(F.col("_turn")), b).bitwiseAND(1)
    return df.withColumn(out, place).drop("_turn", *names)


def _number(df: DataFrame, name: str) -> Column:
    """A dimension as a number in its own order: of a text, its first six bytes."""
    kind = dict(df.dtypes)[name]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.col(name).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind in ("date", "timestamp", "timestamp_ntz"):
        return F.col(name).cast("timestamp").cast("double")
    return F.col(name).cast("double")


def hilbert_shards(docs: DataFrame, dimensions: list[str], shards: int = SHARDS, law: str = "rows", bits: int = BITS, salts: int = SALTS,
                   tie_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(tie column, size, text_crc32, law, shard, slot, grown_shard) of each row.

    ``size`` is the text's UTF-8 bytes (null: none) plus 8. Dimensions are cut into
    ``2**bits`` equal steps between their least and greatest value, nulls with the least.
    Under law ``rows`` shards hold equal numbers of rows (at most one apart), under
    ``bytes`` equal sizes (a row goes where the bytes before it fall). Slots count from 0
    in Hilbert order in each shard. Rows of one cell are ordered by a hash and then the
    value of the tie column; equal rows are told apart arbitrarily, but once. A cell that
    holds a large share of the rows is split by that hash into ``salts`` parts.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    base = docs.select(F.col(tie_col).alias("_tie"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"),
                       *(_number(docs, d).alias(f"_v{i}") for i, d in enumerate(dimensions)))
    base = step(base, "dimensions")
    axes = [f"_a{i}" for i in range(len(dimensions))]
    edges = base.agg(*(f(f"_v{i}").alias(f"_{n}{i}") for i in range(len(axes)) for n, f in (("low", F.min), ("high", F.max))))

    def cell(i: int) -> Column:
        wide = F.col(f"_high{i}") - F.col(f"_low{i}")
        return F.coalesce(F.when(wide > 0, F.least(F.floor((F.col(f"_v{i}") - F.col(f"_low{i}")) / wide * (1 << bits)), F.lit((1 << bits) - 1))), F.lit(0)).cast("int")

    order = F.xxhash64("_tie", "size", "text_crc32")
    placed = base.join(F.broadcast(edges)).select("_tie", "size", "text_crc32", *(cell(i).alias(a) for i, a in enumerate(axes)), order.alias("_order"))
    placed = placed.withColumn("_salt", F.shiftrightunsigned("_order", 64 - max(1, (salts - 1).bit_length())).cast("int"))
    # One row for each cell and salt: at most 2 ** (bits * dimensions) * salts.
    cells = placed.groupBy(*axes, "_salt").agg(F.count(F.lit(1)).alias("_n"), F.sum("size").alias("_bytes"))
    cells = step(hilbert_index(cells, axes, bits, "_hilbert"), "cells")
    curve = Window.orderBy("_hilbert", "_salt").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    cells = cells.withColumns({
        "_before": F.coalesce(F.sum("_n").over(curve), F.lit(0)), "_bytes_before": F.coalesce(F.sum("_bytes").over(curve), F.lit(0)),
        "_rows": F.sum("_n").over(every), "_all": F.sum("_bytes").over(every)}).drop("_n", "_bytes", "_hilbert")
    own = Window.partitionBy(*axes, "_salt").orderBy("_order", "_tie", "size", "text_crc32")
    ranked = placed.withColumn("_rank", F.row_number().over(own) - 1)
    if law == "bytes":
        ranked = ranked.withColumn("_upto", F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = ranked.join(F.broadcast(cells), [*axes, "_salt"])
    rank = F.col("_before") + F.col("_rank")
    if law == "rows":
        shard = F.expr(f"(_before + _rank) * {shards} div _rows")
        ranked = ranked.withColumn("shard", shard.cast("int"))
        slot = rank - F.expr(f"(shard * _rows + {shards - 1}) div {shards}")
    else:
        ranked = step(ranked.withColumn("shard", F.expr(f"(_bytes_before + _upto) * {shards} div _all").cast("int")).withColumn("_place", rank), "ranked")
        starts = ranked.groupBy("shard").agg(F.min("_place").alias("_start"))
        ranked = ranked.join(F.broadcast(starts), "shard")
        slot = F.col("_place") - F.col("_start")
    return ranked.select(F.col("_tie").alias(tie_col), "size", "text_crc32", F.lit(law).alias("law"), "shard", slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op1_hilbert_shards(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return hilbert_shards(docs, ["lang", "source", "n_chars", "doc_id"])
