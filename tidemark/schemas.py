"""Schemas of batches, events and state, and what identifies a stream."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A stream. A key of '' is no key: it is null in every table, so joins compare ``_key``, where null is ''.
STREAM = ("dest_kind", "dest_logical", "topic", "key")
JOIN = ("dest_kind", "dest_logical", "topic", "_key")

_stream = [T.StructField(c, T.StringType(), c == "key") for c in STREAM]
_record = [
    T.StructField("event_id", T.StringType(), False), T.StructField("ts", T.TimestampType(), False), T.StructField("attempt", T.LongType(), False),
    T.StructField("actor_ref", T.StringType()), T.StructField("payload", T.BinaryType(), False),
]
BATCH = T.StructType([T.StructField("ordinal", T.LongType(), False), *_stream, *_record])
EVENT = T.StructType([*_stream, T.StructField("seq", T.LongType(), False), *_record])
#: Events as stored: an append's folder also holds the repeated records of its batch, which are not events.
STORED = T.StructType([*EVENT.fields, T.StructField("ordinal", T.LongType()), T.StructField("is_new", T.BooleanType())])
HEAD = T.StructType([*_stream, T.StructField("next_seq", T.LongType(), False)])
CHECKPOINT = T.StructType([T.StructField("subscription", T.StringType(), False), *_stream, T.StructField("seq", T.LongType(), False)])
TRUNCATION = T.StructType([*_stream, T.StructField("bound", T.LongType(), False), T.StructField("head", T.LongType(), False), T.StructField("version", T.LongType(), False)])


def normal_key(key: Column | str = "key") -> Column:
    return F.when(F.col(key) != "", F.col(key)) if isinstance(key, str) else F.when(key != "", key)


def keyed(df: DataFrame) -> DataFrame:
    """Adds _key, by which streams can be joined with plain equality."""
    return df.withColumn("_key", F.coalesce("key", F.lit("")))


def normal(batch: DataFrame) -> DataFrame:
    """Keys of '' become null, and times are cut to milliseconds, as durable stores hold them."""
    return batch.withColumns({"key": normal_key(), "ts": F.timestamp_millis(F.unix_millis("ts"))})
