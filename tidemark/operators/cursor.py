"""Checkpoints, truncations and lag: append-only rows whose state is a fold, so concurrent writers can't make it fall back."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.schemas import JOIN, STREAM, keyed


def checkpoint_state(commits: DataFrame) -> DataFrame:
    """The highest sequence that each subscription has committed for a stream."""
    return commits.groupBy("subscription", *STREAM).agg(F.max("seq").alias("seq"))


def load_checkpoint(commits: DataFrame, subscription: str) -> DataFrame:
    return checkpoint_state(commits.where(F.col("subscription") == subscription))


def lag(heads: DataFrame, commits: DataFrame) -> DataFrame:
    """Rows that each subscription hasn't acknowledged, for streams that it has committed; 0 for a commit past the head."""
    state = keyed(checkpoint_state(commits))
    ends = keyed(heads).select(*JOIN, "next_seq")
    behind = F.greatest(F.coalesce("next_seq", F.lit(0)) - F.col("seq"), F.lit(0))
    return state.join(ends, list(JOIN), "left").select("subscription", *STREAM, F.col("seq").alias("checkpoint"), F.coalesce("next_seq", F.lit(0)).alias("head"), behind.alias("lag"))


def catch_up(events: DataFrame, commits: DataFrame, subscription: str) -> DataFrame:
    """What a subscription hasn't acknowledged, over all streams."""
    state = keyed(load_checkpoint(commits, subscription)).select(*JOIN, F.col("seq").alias("_at"))
    return keyed(events).join(state, list(JOIN), "left").where(F.col("seq") > F.coalesce("_at", F.lit(0))).drop("_at", "_key")


def floors(truncations: DataFrame) -> DataFrame:
    """Each stream's truncation in force: the highest bound, with the head at the time. Lower bounds that came later did nothing."""
    best = truncations.groupBy(*STREAM).agg(F.max_by(F.struct("bound", "head"), F.struct("bound", -F.col("version"))).alias("t"))
    return best.select(*STREAM, F.col("t.bound").alias("bound"), F.col("t.head").alias("head"))


def visible(events: DataFrame, truncations: DataFrame) -> DataFrame:
    """Rows below a bound go if they were there when it was set; later appends stay visible even below it."""
    floor = keyed(floors(truncations)).select(*JOIN, "bound", "head")
    gone = (F.col("seq") < F.col("bound")) & (F.col("seq") <= F.col("head"))
    return keyed(events).join(floor, list(JOIN), "left").where(F.coalesce(~gone, F.lit(True))).drop("bound", "head", "_key")


def removed(events: DataFrame, truncations: DataFrame, bounds: DataFrame) -> DataFrame:
    """How many visible rows each of ``bounds`` (stream, bound) would remove: none unless it is above the stream's floor."""
    floor = keyed(floors(truncations)).select(*JOIN, F.col("bound").alias("_floor"))
    asked = keyed(bounds).join(floor, list(JOIN), "left").where(F.col("bound") > F.coalesce("_floor", F.lit(0))).select(*JOIN, F.col("bound").alias("_bound"))
    counted = keyed(visible(events, truncations)).join(asked, list(JOIN)).where(F.col("seq") < F.col("_bound")).groupBy(*JOIN).agg(F.count("*").alias("_n"))
    return keyed(bounds).join(counted, list(JOIN), "left").select(*STREAM, "bound", F.coalesce("_n", F.lit(0)).alias("removed"))


def acknowledged(commits: DataFrame) -> DataFrame:
    """The bound up to which every subscription of a stream has acknowledged: what idle reclaim may truncate before."""
    return checkpoint_state(commits).groupBy(*STREAM).agg(F.min("seq").alias("bound"))
