"""Run metrics: nearest-rank percentiles, slopes, ratios and profiles."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(df: DataFrame, value: str, ps: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles p<p> by group: the value at place round(p/100 (n-1)), halves away from zero, of the sorted values.

    Equal values are counted before the shuffle, and places come from running counts, so no group is gathered in memory."""
    by = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    run = F.sum("_n").over(group.orderBy("_v"))
    placed = counts.withColumns({"_run": run, "_all": F.sum("_n").over(group)})
    at = [F.floor(F.lit(p / 100) * (F.col("_all") - 1) + 0.5) + 1 for p in ps]
    return placed.groupBy(*by).agg(*(F.coalesce(F.min(F.when(F.col("_run") >= a, F.col("_v"))), F.lit(0.0)).alias(f"p{p:g}") for p, a in zip(ps, at, strict=True)))


def mean(value: Column | str) -> Column:
    return F.coalesce(F.avg(value), F.lit(0.0))


def slope(y: str, x: str) -> Column:
    """Least squares; 0 for under two points or equal x."""
    return F.coalesce(F.regr_slope(y, x), F.lit(0.0))


#: Ranges of the order that a group is numbered in, each on its own.
PIECES = 64


def indexed(df: DataFrame, order: str, by: Sequence[str] = (), n: bool = False) -> DataFrame:
    """Adds _i, the 0-based place by ``order``, a number, and _n, the group's size.

    The order is cut into PIECES ranges, which are numbered on their own and shifted by the counts of those before, so that a large group is no single task.
    Groups are compared null-safe; rows without an order come first."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    width = max(1e-300, (float(high) - float(low)) / PIECES) if low is not None else 1.0
    piece = F.coalesce(F.floor((F.col(order) - F.lit(low)) / width), F.lit(-1)) if low is not None else F.lit(-1).cast("long")
    cut = df.withColumn("_b", piece)
    before = Window.partitionBy(*by).orderBy("_b") if by else Window.partitionBy(F.lit(0)).orderBy("_b")
    all_ = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    counts = cut.groupBy(*by, "_b").agg(F.count("*").alias("_c")).select(F.struct(*by, "_b").alias("_k"), (F.sum("_c").over(before) - F.col("_c")).alias("_before"), F.sum("_c").over(all_).alias("_n"))
    place = F.row_number().over(Window.partitionBy(*by, "_b").orderBy(order)) - 1
    out = cut.withColumns({"_i": place, "_k": F.struct(*by, "_b")}).join(counts, "_k").withColumn("_i", (F.col("_i") + F.col("_before")).cast("long"))
    return out.drop("_k", "_b", "_before", *([] if n else ["_n"]))


def slope_vs_index(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    return indexed(df, order, by).groupBy(*by).agg(slope(value, "_i").alias("slope_vs_index"))


def decile_p95_slope(df: DataFrame, value: str, order: str, by: Sequence[str] = ()) -> DataFrame:
    """The slope of the 95th percentiles of ten equal chunks; what is left after ten is dropped; 0 for under 20 samples."""
    slopes = _deciles(indexed(df, order, by, n=True), value, by)
    if not by:
        return slopes
    return df.select(*by).distinct().join(slopes, list(by), "left").select(*by, F.coalesce("decile_p95_slope", F.lit(0.0)).alias("decile_p95_slope"))


def _deciles(placed: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    chunk = F.floor(F.col("_i") / F.floor(F.col("_n") / 10)).cast("long")
    p95 = nearest_rank(placed.where("_n >= 20").withColumn("_c", chunk).where("_c < 10"), value, [95], [*by, "_c"])
    return p95.groupBy(*by).agg(slope("p95", "_c").alias("decile_p95_slope"))


def growth_ratio(before: Column, after: Column) -> Column:
    return F.when(before == 0, F.when(after == 0, 1.0).otherwise(float("inf"))).otherwise(after / before)


def error_rate(errors: Column, total: Column) -> Column:
    return F.when(total == 0, 0.0).otherwise(errors / total)


def per_op(count: Column, ok: Column) -> Column:
    return F.coalesce(F.try_divide(count, ok), F.lit(0.0))


def size_gib(text: Column) -> Column:
    """'1.9T', '500G' or '512M' as GiB, 0 for anything else."""
    number = F.regexp_extract(F.trim(text), r"^([0-9]+(?:\.[0-9]+)?)[TGM]$", 1).try_cast("double")
    unit = F.substring(F.trim(text), -1, 1)
    return F.coalesce(F.when(unit == "T", number * 1024).when(unit == "G", number).when(unit == "M", number / 1024), F.lit(0.0))


def summary(df: DataFrame, value: str, order: str, by: Sequence[str]) -> DataFrame:
    """p50, p95, p99, mean, count and both slopes."""
    by = list(by)
    placed = indexed(df, order, by, n=True)
    base = placed.groupBy(*by).agg(mean(value).alias("mean"), F.count(value).alias("sample_count"), slope(value, "_i").alias("slope_vs_index"))
    out = base.join(nearest_rank(df, value, [50, 95, 99], by), by, "left").join(_deciles(placed, value, by), by, "left")
    return out.withColumn("decile_p95_slope", F.coalesce("decile_p95_slope", F.lit(0.0)))


def resource_profile(samples: DataFrame, value: str, ts: str, by: Sequence[str] = ()) -> DataFrame:
    """max, mean, first and last of samples over time; the peak is at least the first and last."""
    first, last = F.min_by(value, ts), F.max_by(value, ts)
    return samples.groupBy(*by).agg(F.greatest(F.max(value), first, last).alias("peak"), mean(value).alias("mean"), first.alias("first"), last.alias("last"))


def directory_bytes(files: DataFrame) -> DataFrame:
    """The size of what a binaryFile source lists."""
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
