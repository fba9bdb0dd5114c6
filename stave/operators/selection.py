"""Import groups and their selection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stave.operators.timeline import keep_first


def candidate_groups(candidates: DataFrame, provider: str = "youtube") -> DataFrame:
    """One group per candidate, in order: search, playlist, resolvable source or direct."""
    kind, value = F.col("kind"), F.col("input")
    squashed = F.lower(F.regexp_replace(F.trim("input"), r"\s+", " "))
    source = (kind == "video") & F.col("source_url").isNotNull()
    return candidates.select(
        "batch_id", F.col("seq").alias("group_seq"),
        F.when(kind == "search", F.concat(F.lit(f"search:{provider}:"), squashed))
        .when(kind == "playlist", F.concat(F.lit("playlist:"), value))
        .when(source, F.concat(F.lit("source:"), value)).otherwise(F.concat(F.lit("direct:"), value)).alias("group_id"),
        F.when(kind.isin("search", "playlist"), kind).otherwise("direct").alias("group_kind"),
        F.when(kind.isin("search", "playlist") | source, value).alias("query"), value.alias("own_input"),
        F.coalesce("blocked", F.lit(False)).alias("own_blocked"),
    )


def group_expand(groups: DataFrame, resolved: DataFrame) -> DataFrame:
    """Members of each group after resolution; a source that resolves to several rows becomes a playlist.

    ``resolved``: batch_id, group_id, member_seq, input, blocked. Direct groups,
    and sources not resolved yet, hold their own candidate.
    """
    sizes = resolved.groupBy("batch_id", "group_id").agg(F.count(F.lit(1)).alias("n_members"))
    sized = groups.join(sizes, ["batch_id", "group_id"], "left")
    is_source = F.col("group_id").startswith("source:")
    kind = F.when(is_source & (F.col("n_members") > 1), "playlist").otherwise(F.col("group_kind"))
    base = ["batch_id", "group_seq", "group_id", kind.alias("group_kind"), "query"]
    own = sized.where(F.col("n_members").isNull() & ~F.col("group_kind").isin("search", "playlist")).select(
        *base, F.lit(0).alias("member_seq"), F.col("own_input").alias("input"), F.col("own_blocked").alias("blocked"))
    members = sized.where(F.col("n_members").isNotNull()).select(*base, "n_members").join(
        resolved.select("batch_id", "group_id", "member_seq", "input", "blocked"), ["batch_id", "group_id"]
    ).select("batch_id", "group_seq", "group_id", "group_kind", "query", "member_seq", "input", "blocked")
    return own.unionByName(members)


def _pick(members: DataFrame, auto: bool, by_size_of_all: bool) -> DataFrame:
    """Members a group selects by itself."""
    keys = ["batch_id", "group_id"]
    every = F.col("query").isNull() | (F.col("group_kind") == "playlist")
    open_members = members.where(~F.col("blocked"))
    counted = members.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_all"), F.count_if(~F.col("blocked")).alias("_open"))
    first = keep_first(open_members.select(*keys, "group_seq", "member_seq", "input"), keys, ["member_seq"]).select(
        *keys, F.col("member_seq").alias("_first"))
    joined = open_members.join(counted, keys).join(first, keys)
    lone = F.col("_all") == 1 if by_size_of_all else F.col("_open") == 1
    chosen = every | (lone | F.lit(auto)) & (F.col("member_seq") == F.col("_first"))
    return joined.where(chosen).select("batch_id", "input").distinct()


def default_selection(members: DataFrame, auto: bool = False) -> DataFrame:
    """Everything open in direct and playlist groups; in others the only open member, or the first when automatic."""
    return _pick(members, auto, by_size_of_all=False)


def reconcile_selection(selected: DataFrame, previous: DataFrame, following: DataFrame, auto: bool = False) -> DataFrame:
    """Selection kept where still offered, plus members that are new and selected by themselves.

    ``selected``: batch_id, input; ``previous`` and ``following`` are group members.
    """
    keys = ["batch_id", "input"]
    offered = following.where(~F.col("blocked")).select(*keys).distinct()
    kept = selected.select(*keys).distinct().join(offered, keys, "left_semi")
    fresh = _pick(following, auto, by_size_of_all=True).join(previous.select(*keys).distinct(), keys, "left_anti")
    return kept.unionByName(fresh).distinct()
