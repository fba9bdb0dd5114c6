"""Ordered operations over keyed timelines that survive one hot key.

A window partitioned by track puts a whole track in one task. That is right
while tracks are bounded, and wrong when one key holds a third of the rows. So
every ordered operator here goes through :func:`annotate`: keys above
``spark.stave.blockRows`` rows are cut into blocks along the time axis, the
window runs per (key, block), and one summary row per block (a partial
aggregate) carries state over block borders. When no key is that large, which
one aggregate over the key column establishes, the plan is the plain window
with a single exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stave.session import block_rows, staged

# More hot keys than this are joined by shuffle instead of broadcast.
MAX_BROADCAST_HOT_KEYS = 50_000


def _struct(exprs: Mapping[str, Column]) -> Column:
    return F.struct(*[value.alias(name) for name, value in exprs.items()])


PROBE = object()


#: Cuts kept for a hot key, and so the most blocks it is dealt into.
GRID = 512


def hot_keys(df: DataFrame, keys: Sequence[str], axis: str) -> DataFrame | None:
    """Keys with more rows than a block may hold, with cuts at even shares of their rows; None when there is none.

    Both aggregates, of the counts and of the quantile sketches of hot keys, are
    combined map-side. The result may be passed to several :func:`annotate` calls over
    rows of the same table.
    """
    most = block_rows(df.sparkSession)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_hot_n")).where(F.col("_hot_n") > most)
    found = hot.limit(MAX_BROADCAST_HOT_KEYS + 1).count()
    if found == 0:
        return None
    few = found <= MAX_BROADCAST_HOT_KEYS
    named = F.broadcast(hot) if few else hot
    shares = F.array(*[F.lit(i / GRID) for i in range(1, GRID)])
    sketch = df.select(*keys, F.col(axis).cast("double").alias("_axis")).join(named, list(keys)).groupBy(*keys).agg(
        F.max("_hot_n").alias("_hot_n"), F.percentile_approx("_axis", shares, 10 * GRID).alias("_grid"))
    # of the grid every so many cuts, so that a block holds about the rows it may
    stride = F.greatest(F.lit(1), F.floor(F.lit(GRID) * F.lit(most) / F.col("_hot_n"))).cast("int")
    cuts = F.array_distinct(F.filter("_grid", lambda cut, i: (i + 1) % stride == 0))
    # written, as a plan would otherwise hold the rows' lineage once more for each ordered step
    made = staged(sketch.select(*keys, cuts.alias("_hot_cuts")), "hot")
    return F.broadcast(made) if few else made


def _with_blocks(df: DataFrame, keys: Sequence[str], axis: str, hot: DataFrame) -> DataFrame:
    """Add ``_blk``: the block along the axis for hot keys, null for others."""
    block = F.size(F.filter("_hot_cuts", lambda cut: cut <= F.col(axis))).cast("bigint")
    return df.join(hot, list(keys), "left").withColumn("_blk", F.when(F.col("_hot_cuts").isNotNull(), block)).drop("_hot_cuts")


def annotate(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    *,
    ordinal: str | None = None,
    lag: Mapping[str, Column] | None = None,
    lead: Mapping[str, Column] | None = None,
    last: Mapping[str, Column] | None = None,
    upcoming: Mapping[str, Column] | None = None,
    running: Mapping[str, Column] | None = None,
    peak: Mapping[str, Column] | None = None,
    hot: DataFrame | None | object = PROBE,
    tasks: int | None = None,
) -> DataFrame:
    """Add order-dependent columns per key.

    ``order`` names columns giving a total order, the first one numeric (it is
    the axis blocks are cut along). ``ordinal`` is the 0-based position, ``lag``
    and ``lead`` the neighbouring row's value, ``last`` the last non-null value
    up to and including the row, ``upcoming`` the first non-null value from the
    row on, ``running`` the inclusive sum and ``peak`` the maximum over strictly
    earlier rows. ``hot`` is the answer of an earlier :func:`hot_keys`;
    ``tasks`` the number of tasks the rows are dealt over, instead of the session's.
    """
    keys, order = list(keys), list(order)
    lag, lead, last = dict(lag or {}), dict(lead or {}), dict(last or {})
    upcoming, running, peak = dict(upcoming or {}), dict(running or {}), dict(peak or {})
    if hot is PROBE:
        hot = hot_keys(df, keys, order[0])
    blocked = None if hot is None else _with_blocks(df, keys, order[0], hot)
    hot = blocked is not None
    names = list(df.columns)
    if hot:
        by, source = [*keys, "_blk"], _carry(blocked, keys, order, ordinal, lag, lead, last, upcoming, running, peak)
    else:
        by, source = keys, df
    if tasks:
        source = source.repartition(tasks, *by)

    forward = Window.partitionBy(*by).orderBy(*order)
    to_here = forward.rowsBetween(Window.unboundedPreceding, 0)
    before = forward.rowsBetween(Window.unboundedPreceding, -1)
    from_end = (
        Window.partitionBy(*by)
        .orderBy(*[F.col(name).desc() for name in order])
        .rowsBetween(Window.unboundedPreceding, 0)
    )

    def carried(kind: str, name: str) -> Column:
        return F.col(f"_c_{kind}")[name] if kind in ("lag", "lead") else F.col(f"_c_{kind}_{name}")

    added: dict[str, Column] = {}
    if ordinal:
        count = (F.row_number().over(forward) - 1).cast("bigint")
        added[ordinal] = count + F.coalesce(F.col("_c_n"), F.lit(0)) if hot else count
    for name, value in lag.items():
        inside = F.lag(value).over(forward)
        added[name] = (
            F.when(F.row_number().over(forward) == 1, carried("lag", name)).otherwise(inside) if hot else inside
        )
    for name, value in lead.items():
        inside = F.lead(value).over(forward)
        added[name] = (
            F.when(F.lead(F.lit(1)).over(forward).isNull(), carried("lead", name)).otherwise(inside)
            if hot
            else inside
        )
    for name, value in last.items():
        inside = F.last(value, ignorenulls=True).over(to_here)
        added[name] = F.coalesce(inside, carried("last", name)) if hot else inside
    for name, value in upcoming.items():
        inside = F.last(value, ignorenulls=True).over(from_end)
        added[name] = F.coalesce(inside, carried("upcoming", name)) if hot else inside
    for name, value in running.items():
        inside = F.sum(value).over(to_here)
        added[name] = inside + F.coalesce(carried("running", name), F.lit(0)) if hot else inside
    for name, value in peak.items():
        inside = F.max(value).over(before)
        added[name] = F.greatest(inside, carried("peak", name)) if hot else inside
    return source.select(*[F.col(f"`{n}`") for n in names], *[c.alias(n) for n, c in added.items()])


def _carry(blocked, keys, order, ordinal, lag, lead, last, upcoming, running, peak) -> DataFrame:
    """Join to each row what the other blocks of its key contribute."""
    rank = F.struct(*order)
    parts: list[Column] = [F.count(F.lit(1)).alias("_s_n")]
    if lag:
        parts.append(F.max_by(_struct(lag), rank).alias("_s_lag"))
    if lead:
        parts.append(F.min_by(_struct(lead), rank).alias("_s_lead"))
    for name, value in last.items():
        parts.append(F.max_by(value, F.when(value.isNotNull(), rank)).alias(f"_s_last_{name}"))
    for name, value in upcoming.items():
        parts.append(F.min_by(value, F.when(value.isNotNull(), rank)).alias(f"_s_upcoming_{name}"))
    for name, value in running.items():
        parts.append(F.sum(value).alias(f"_s_running_{name}"))
    for name, value in peak.items():
        parts.append(F.max(value).alias(f"_s_peak_{name}"))
    summary = blocked.where(F.col("_blk").isNotNull()).groupBy(*keys, "_blk").agg(*parts)
    across = Window.partitionBy(*keys).orderBy("_blk")
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)
    later = (
        Window.partitionBy(*keys).orderBy(F.col("_blk").desc()).rowsBetween(Window.unboundedPreceding, -1)
    )
    carry: list[Column] = []
    if ordinal:
        carry.append(F.sum("_s_n").over(earlier).alias("_c_n"))
    if lag:
        carry.append(F.lag("_s_lag").over(across).alias("_c_lag"))
    if lead:
        carry.append(F.lead("_s_lead").over(across).alias("_c_lead"))
    for name in last:
        carry.append(F.last(f"_s_last_{name}", ignorenulls=True).over(earlier).alias(f"_c_last_{name}"))
    for name in upcoming:
        carry.append(F.last(f"_s_upcoming_{name}", ignorenulls=True).over(later).alias(f"_c_upcoming_{name}"))
    for name in running:
        carry.append(F.sum(f"_s_running_{name}").over(earlier).alias(f"_c_running_{name}"))
    for name in peak:
        carry.append(F.max(f"_s_peak_{name}").over(earlier).alias(f"_c_peak_{name}"))
    state = summary.select(*keys, "_blk", *carry)
    return blocked.join(state, [*keys, "_blk"], "left")


def asof(
    points: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    point_t: Column,
    anchor_t: Column,
    payload: Sequence[str],
    *,
    ties: Sequence[str] = (),
    before: str | None = "prev",
    after: str | None = None,
    equal: str = "before",
    tasks: int | None = None,
) -> DataFrame:
    """For each point, the latest anchor at or before it and/or the first after it.

    Adds struct columns ``before`` and ``after`` holding ``payload`` and the
    anchor time ``t``; null where there is none. One union, one exchange on the
    key: points and anchors are sorted together, so no inequality join is made.
    An anchor at exactly the point's time counts as ``equal``: ``"before"`` or
    ``"after"``. ``ties`` orders anchors sharing one time; the last of them wins
    looking back and the first of them wins looking forward.
    """
    keys = list(keys)
    anchor_side = 0 if equal == "before" else 2
    names = points.columns
    tie_types = [anchors.schema[name].dataType for name in ties]
    left = points.select(
        *keys,
        point_t.alias("_t"),
        F.lit(1).alias("_side"),
        *[F.lit(None).cast(kind).alias(f"_tie{i}") for i, kind in enumerate(tie_types)],
        F.struct(*[F.col(f"`{n}`") for n in names]).alias("_p"),
        F.lit(None).cast(_payload_type(anchors, anchor_t, payload)).alias("_a"),
    )
    right = anchors.select(
        *keys,
        anchor_t.alias("_t"),
        F.lit(anchor_side).alias("_side"),
        *[F.col(name).alias(f"_tie{i}") for i, name in enumerate(ties)],
        F.lit(None).cast(left.schema["_p"].dataType).alias("_p"),
        F.struct(anchor_t.alias("t"), *payload).alias("_a"),
    )
    merged = left.unionByName(right)
    out = annotate(
        merged,
        keys,
        ["_t", "_side", *[f"_tie{i}" for i in range(len(ties))]],
        last={"_before": F.col("_a")} if before else None,
        upcoming={"_after": F.col("_a")} if after else None,
        tasks=tasks,
    ).where(F.col("_side") == 1)
    # the keys as they are, so that their partitioning is kept
    kept = [F.col(n) if n in keys else F.col("_p")[n].alias(n) for n in names]
    if before:
        kept.append(F.col("_before").alias(before))
    if after:
        kept.append(F.col("_after").alias(after))
    return out.select(*kept)


def _payload_type(anchors: DataFrame, anchor_t: Column, payload: Sequence[str]):
    return anchors.select(F.struct(anchor_t.alias("t"), *payload).alias("s")).schema["s"].dataType


def nearest(
    points: DataFrame,
    anchors: DataFrame,
    keys: Sequence[str],
    point_t: Column,
    anchor_t: Column,
    payload: Sequence[str] = (),
    *,
    ties: Sequence[str] = (),
    later_wins: bool = False,
) -> DataFrame:
    """Add struct ``hit``: the anchor nearest in time; equal distance goes to the earlier one."""
    names = points.columns
    tagged = points.select("*", point_t.alias("_pt"))
    both = asof(tagged, anchors, keys, F.col("_pt"), anchor_t, payload, ties=ties, before="_b", after="_f")
    gap_back = F.col("_pt") - F.col("_b.t")
    gap_on = F.col("_f.t") - F.col("_pt")
    back = gap_back < gap_on if later_wins else gap_back <= gap_on
    hit = F.when(F.col("_f").isNull() | back, F.col("_b")).otherwise(F.col("_f"))
    return both.select(*[F.col(f"`{n}`") for n in names], hit.alias("hit"))


def overlap_join(
    intervals: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    interval: tuple[Column, Column],
    window: tuple[Column, Column],
    width: float,
) -> DataFrame:
    """Pairs whose half-open spans overlap, by equi-join on (key, time bin).

    Each span is expanded to the bins of ``width`` it touches; a pair met in
    several bins is kept in the first common one only, so no distinct is needed.
    Both inputs' columns are kept; names must not collide except for the keys.
    """
    keys = list(keys)

    def binned(df: DataFrame, span: tuple[Column, Column], tag: str) -> DataFrame:
        low, high = span
        first = F.floor(low / F.lit(width)).cast("bigint")
        final = F.greatest(first, F.ceil(high / F.lit(width)).cast("bigint") - 1)
        return df.select("*", low.alias(f"_{tag}lo"), high.alias(f"_{tag}hi"), first.alias(f"_{tag}b")).withColumn(
            "_bin", F.explode(F.sequence(F.col(f"_{tag}b"), final))
        )

    left = binned(intervals, interval, "i")
    right = binned(ranges, window, "w")
    joined = left.join(right, [*keys, "_bin"])
    return joined.where(
        (F.col("_ilo") < F.col("_whi"))
        & (F.col("_wlo") < F.col("_ihi"))
        & (F.col("_bin") == F.greatest("_ib", "_wb"))
    ).drop("_bin", "_ilo", "_ihi", "_ib", "_wlo", "_whi", "_wb")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in ``order``; a partial aggregate, so a hot key costs no more than a cold one."""
    rest = [name for name in df.columns if name not in keys]
    row = F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")
    picked = df.groupBy(*keys).agg(row)
    return picked.select(*[F.col(n) if n in keys else F.col("_row")[n].alias(n) for n in df.columns])


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key in ``order``; see :func:`keep_first`."""
    rest = [name for name in df.columns if name not in keys]
    row = F.max_by(F.struct(*rest), F.struct(*order)).alias("_row")
    picked = df.groupBy(*keys).agg(row)
    return picked.select(*[F.col(n) if n in keys else F.col("_row")[n].alias(n) for n in df.columns])
