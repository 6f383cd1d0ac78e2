"""Workloads as sources: records, and the streams that they go to."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_BYTES = 256


def records(spark: SparkSession, n: int, topic: str = "bench", key: Column | None = None, kind: str = "memory", seed: int = 1) -> DataFrame:
    """n records with zero payloads; ids are random but fixed by the seed, so a lost task makes the same ones again."""
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("id").cast("string")).cast("binary"))
    uuid = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(F.lit("a"), F.substring(h, 18, 3)), F.substring(h, 21, 12))
    return spark.range(n).select(
        F.col("id").alias("ordinal"), F.lit(kind).alias("dest_kind"), F.lit("bench").alias("dest_logical"), F.lit(topic).alias("topic"), (key if key is not None else F.lit(None)).cast("string").alias("key"), uuid.alias("event_id"),
        F.timestamp_millis(F.lit(1704067200000) + F.col("id")).alias("ts"), F.lit(0).cast("long").alias("attempt"), F.lit(None).cast("string").alias("actor_ref"), F.unhex(F.lit("00" * PAYLOAD_BYTES)).alias("payload"),
    )


def load_key(i: Column, partitions: int) -> Column:
    """partition_<i mod K>, or the one hot stream."""
    return F.concat(F.lit("partition_"), F.pmod(i, F.lit(partitions)).cast("string")) if partitions > 1 else F.lit(None).cast("string")


def worker_key(w: Column) -> Column:
    return F.concat(F.lit("worker_"), w.cast("string"))


def partition_key(w: Column, k: int, offset: int = 0) -> Column:
    return F.concat(F.lit("partition_"), (F.lit(offset) + F.pmod(w, F.lit(k))).cast("string"))


def worker_topic(w: Column, t: int, offset: int = 0) -> Column:
    return F.concat(F.lit("bm-m5-t"), (F.lit(offset) + F.pmod(w, F.lit(t))).cast("string"))


def paced(spark: SparkSession, per_second: int) -> DataFrame:
    """A stream of so many rows a second."""
    return spark.readStream.format("rate").option("rowsPerSecond", per_second).load()
