"""Append and read as DataFrame operations, without any I/O.

Batches carry ``ordinal``, the caller's order. Sequences are dense, start at 1 and follow the ordinals in each stream.
"""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.schemas import JOIN, STREAM, keyed, normal

#: Fixed value: rows that one read may ask for.
MAX_LIMIT = 10_000
MAX_ATTEMPT = 4_294_967_295


INVALID = "a record has no topic, no id or an attempt out of range"


def invalid() -> Column:
    return (F.coalesce("topic", F.lit("")) == "") | F.col("event_id").isNull() | ~F.col("attempt").between(0, MAX_ATTEMPT)


def validate(batch: DataFrame) -> None:
    """An empty topic, a missing id or an attempt out of range; an empty batch is valid."""
    if batch.where(invalid()).take(1):
        raise errors.Validation(INVALID)


def policy(topic: Column, default: str = "lwt", by_topic: dict[str, str] | None = None) -> Column:
    """The idempotency mode of a topic: its own, else the default (lwt: exactly once, none: at least once)."""
    out = F.lit(default)
    for name, mode in (by_topic or {}).items():
        out = F.when(topic == name, mode).otherwise(out)
    return out


def first_ordinal(batch: DataFrame, mode: Column | None = None) -> DataFrame:
    """Adds ``first``: the ordinal of the first record with the same id in the same stream, the own one where nothing is deduplicated."""
    first = F.min("ordinal").over(Window.partitionBy(*JOIN, "event_id"))
    return batch.withColumn("first", first if mode is None else F.when(mode == "none", F.col("ordinal")).otherwise(first))


def allocate(rows: DataFrame, heads: DataFrame | None = None, buckets: int = 1) -> DataFrame:
    """Adds ``seq``: the stream's head plus the place by ordinal.

    A stream is one window partition. With ``buckets`` over 1, ordinals are cut into so many ranges that are numbered on their own and
    shifted by the counts of the ranges before, so that a hot stream is spread over tasks too."""
    if buckets > 1:
        low, high = rows.agg(F.min("ordinal"), F.max("ordinal")).first()
        width = max(1, -(-(((high or 0) - (low or 0)) + 1) // buckets))
        cut = rows.withColumn("_b", F.floor((F.col("ordinal") - F.lit(low or 0)) / width))
        before = Window.partitionBy(*JOIN).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        counts = cut.groupBy(*JOIN, "_b").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
        place = F.row_number().over(Window.partitionBy(*JOIN, "_b").orderBy("ordinal")).cast("long")
        rows = cut.withColumn("_place", place).join(counts, [*JOIN, "_b"]).withColumn("_place", F.col("_place") + F.col("_before")).drop("_b", "_before")
    else:
        # by the columns themselves, so that a filter on a stream goes below the numbering
        rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*STREAM).orderBy("ordinal")).cast("long"))
    if heads is not None:
        rows = rows.join(keyed(heads).select(*JOIN, "next_seq"), list(JOIN), "left").withColumn("_place", F.col("_place") + F.coalesce("next_seq", F.lit(0))).drop("next_seq")
    return rows.withColumnRenamed("_place", "seq")


def block_head(head: Column, block: int = 64) -> Column:
    """The head after a restart where sequences were reserved in blocks: the rest of the last block is lost."""
    return (F.ceil(head / block) * block).cast("long")


def plan_append(batch: DataFrame, stored: DataFrame | None = None, heads: DataFrame | None = None, mode: Column | None = None, buckets: int = 1) -> DataFrame:
    """The batch with ``seq`` and ``is_new``: new records get the next sequences of their stream in the order of their ordinals; a record
    whose id the stream has, or which an earlier one of the batch has, gets that one's sequence and is not new.

    stored: streams, event_id and seq of what the log holds. mode: a column of the batch, see ``policy``. All is planned over ordinals, streams and ids;
    the other columns join once, at the end."""
    batch = normal(batch)
    rows = first_ordinal(keyed(batch.select("ordinal", *STREAM, "event_id")), mode)
    firsts = rows.where("ordinal = first")
    if stored is not None:
        ids = keyed(stored).groupBy(*JOIN, "event_id").agg(F.min("seq").alias("_old"))
        firsts = firsts.join(ids, [*JOIN, "event_id"], "left")
        if mode is not None:
            firsts = firsts.withColumn("_old", F.when(mode != "none", F.col("_old")))
    else:
        firsts = firsts.withColumn("_old", F.lit(None).cast("long"))
    new = allocate(firsts.where("_old is null"), heads, buckets).select("first", F.col("seq").alias("_seq"))
    old = firsts.where("_old is not null").select("first", F.col("_old").alias("_seq"))
    got = new.withColumn("_new", F.lit(True)).unionByName(old.withColumn("_new", F.lit(False)))
    planned = rows.join(got, "first").select("ordinal", F.col("_seq").alias("seq"), (F.col("_new") & (F.col("ordinal") == F.col("first"))).alias("is_new"))
    return batch.join(planned, "ordinal")


def heads(events: DataFrame) -> DataFrame:
    """The last sequence of each stream."""
    return events.groupBy(*STREAM).agg(F.max("seq").alias("next_seq"))


def on_stream(topic: str, key: str | None = None, kind: str | None = None, logical: str | None = None) -> Column:
    """Whether a row belongs to a stream. Topics are compared as they are: no pattern characters, no case folding."""
    out = (F.col("topic") == topic) & F.col("key").eqNullSafe(F.lit(key or None))
    return out & on_destination(kind, logical)


def on_destination(kind: str | None, logical: str | None) -> Column:
    out = F.lit(True)
    if kind is not None:
        out = out & (F.col("dest_kind") == kind)
    return out & (F.col("dest_logical") == logical) if logical is not None else out


def allowed(limit):
    """Whether a read may ask for so many rows: a number, or a column of them."""
    return limit <= MAX_LIMIT


def check_limit(limit: int) -> None:
    if not allowed(limit):
        raise errors.Validation(f"a read asks for {limit} rows; {MAX_LIMIT} are allowed")


def read_from(events: DataFrame, stream: Column, after: int, limit: int) -> DataFrame:
    """The stream's rows after a sequence, ascending, at most ``limit``."""
    check_limit(limit)
    return events.where(stream & (F.col("seq") > after)).orderBy("seq").limit(limit)


def read_from_topic(events: DataFrame, topic: Column, after: int, limit: int) -> DataFrame:
    """Rows of all keys of a topic; ``after`` holds in each stream, the order is by sequence, then key with none first."""
    check_limit(limit)
    return events.where(topic & (F.col("seq") > after)).orderBy("seq", F.col("key").asc_nulls_first()).limit(limit)


def read_topic_page(events: DataFrame, topic: Column, cursor: tuple[int, str | None] | None, limit: int) -> DataFrame:
    """As read_from_topic, but after a (sequence, key) pair, so that no equal sequence of another key is skipped."""
    check_limit(limit)
    if cursor is not None:
        seq, key = cursor
        topic = topic & ((F.col("seq") > seq) | (F.col("seq") == seq) & (F.coalesce("key", F.lit("")) > (key or "")))
    return events.where(topic).orderBy("seq", F.col("key").asc_nulls_first()).limit(limit)


def pages(events: DataFrame, size: int = MAX_LIMIT) -> DataFrame:
    """How many rows each page of each stream has, for a reader that takes ``size`` rows at a time after the last one it saw."""
    check_limit(size)
    page = F.row_number().over(Window.partitionBy(*STREAM).orderBy("seq"))
    return events.withColumn("page", F.floor((page - 1) / size)).groupBy(*STREAM, "page").agg(F.count("*").alias("n"))


def read_many(events: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` rows of each stream in one scan."""
    check_limit(limit)
    place = F.row_number().over(Window.partitionBy(*STREAM).orderBy("seq"))
    return events.withColumn("_p", place).where(F.col("_p") <= limit).drop("_p")


def streams(events: DataFrame) -> DataFrame:
    """The streams that have rows."""
    return events.select(*STREAM).distinct()


def known(events: DataFrame, topics: Iterable[str]) -> DataFrame:
    return streams(events.where(F.col("topic").isin(*topics)))
