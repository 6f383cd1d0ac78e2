"""The log contract, and the cases around it."""

import itertools

import pytest
from pyspark.sql import functions as F

from tidemark import errors, schemas
from tidemark.operators import cursor, log, workload
from tidemark.sources.store import LogStore
from tidemark.telemetry import ConsoleSink, Instrumented, NoSink, sink_from_env


def rows(spark, items, topic="t", key=None, payload=b"\x07\x08\x09"):
    """items: ids, or (id, topic, key)."""
    full = [x if isinstance(x, tuple) else (x, topic, key) for x in items]
    raw = [(i, "memory", "default", t, k, e, 1704067200000 + i, 0, None, bytearray(payload)) for i, (e, t, k) in enumerate(full)]
    d = spark.createDataFrame(raw, "ordinal long, dest_kind string, dest_logical string, topic string, key string, event_id string, ms long, attempt long, actor_ref string, payload binary")
    return d.withColumn("ts", F.timestamp_millis("ms")).drop("ms").select(schemas.BATCH.names)


def seqs(df):
    return [r.seq for r in df.orderBy("ordinal").collect()]


def listed(df):
    return [(r.seq, r.key) for r in df.collect()]


@pytest.fixture
def store(spark, tmp_path):
    return LogStore(spark, str(tmp_path / "log"))


def test_append_and_read(spark, store):
    assert seqs(store.append(rows(spark, []))) == []
    assert store.read_from("t", None, 0, 10).count() == 0
    assert seqs(store.append(rows(spark, ["a"]))) == [1]
    assert seqs(store.append(rows(spark, ["b", "c", "d"]))) == [2, 3, 4]
    assert listed(store.read_from("t", None, 0, 10)) == [(i, None) for i in range(1, 5)]
    assert listed(store.read_from("t", None, 2, 1)) == [(3, None)]
    assert store.read_from("t", None, 0, 0).count() == 0 and store.read_from("other", None, 0, 10).count() == 0
    with pytest.raises(errors.Validation):
        store.read_from("t", None, 0, 10_001)
    with pytest.raises(errors.Validation):
        store.append(rows(spark, ["x"], topic=""))
    assert store.append(rows(spark, [], topic="")).count() == 0
    # the first payload stays
    assert seqs(store.append(rows(spark, ["a", "e", "e"], payload=b"\0"))) == [1, 5, 5]
    assert {r.event_id: bytes(r.payload) for r in store.events().collect()}["a"] == b"\x07\x08\x09"
    # a reopened store has all of it
    again = LogStore(spark, store.path)
    assert listed(again.read_from("t", None, 4, 9)) == [(5, None)] and sum(len(p) for p in again.read_all("t", None, 2)) == 5


def test_topics_and_keys(spark, store):
    store.append(rows(spark, [("1", "t", "a"), ("2", "t", "a"), ("3", "t", "b"), ("4", "t", ""), ("5", "t", None), ("6", "T", "a"), ("7", "t_", "a"), ("8", "tx", "a"), ("9", "t%", "a")]))
    assert listed(store.read_from_topic("t", None, 0, 100)) == [(1, None), (1, "a"), (1, "b"), (2, None), (2, "a")]
    assert listed(store.read_from_topic("t", None, 1, 1)) == [(2, None)]
    assert listed(store.read_from_topic("t", "a", 1, 5)) == [(2, "a")] and listed(store.read_from_topic("t_", None, 0, 5)) == [(1, "a")]
    first = log.read_topic_page(store.events(), F.col("topic") == "t", None, 2)
    assert listed(log.read_topic_page(store.events(), F.col("topic") == "t", (1, "a"), 2)) == [(1, "b"), (2, None)] and len(listed(first)) == 2


def test_many_keys_top_k(spark):
    e = spark.range(1000).select(F.lit("memory").alias("dest_kind"), F.lit("d").alias("dest_logical"), F.lit("t").alias("topic"), (F.col("id") % 200).cast("string").alias("key"), (F.floor(F.col("id") / 200) + 1).cast("long").alias("seq"))
    got = listed(log.read_from_topic(e, F.col("topic") == "t", 0, 5))
    assert got == [(1, k) for k in sorted(map(str, range(200)))[:5]]


def test_checkpoints(spark, store):
    assert store.load_checkpoint("s", "t", None) is None
    store.commit_checkpoint("s", "t", None, 5)
    store.commit_checkpoint("s", "t", "", 3)
    assert store.load_checkpoint("s", "t", None) == 5 and store.load_checkpoint("s", "t", "k") is None and store.load_checkpoint("z", "t", None) is None


def test_checkpoint_order_does_not_matter(spark):
    for p in itertools.permutations([1, 5, 3]):
        c = spark.createDataFrame([("s", "m", "d", "t", None, x) for x in p], schemas.CHECKPOINT)
        assert cursor.checkpoint_state(c).first().seq == 5


def test_truncate(spark, store):
    assert store.truncate_before("t", None, 5) == 0
    store.append(rows(spark, ["a", "b", "c"]))
    # that bound stays in force, but rows that came after it are there
    assert [r.seq for r in store.read_from("t", None, 0, 9).collect()] == [1, 2, 3]
    assert store.truncate_before("t", None, 2) == 0
    assert store.truncate_before("t", None, 100) == 3 and store.events().count() == 0
    assert seqs(store.append(rows(spark, ["d", "a"]))) == [4, 1]
    assert listed(store.read_from("t", None, 0, 9)) == [(4, None)]
    assert store.truncate_before("t", None, 50) == 0 and store.events().count() == 1
    store.compact()
    assert listed(store.read_from("t", None, 0, 9)) == [(4, None)] and seqs(store.append(rows(spark, ["b", "e"]))) == [2, 5]
    assert store.truncate_before("t", None, 60) == 0


def test_lifecycle_after_compaction(spark, store):
    store.append(rows(spark, ["a", "b"]))
    store.commit_checkpoint("s", "t", None, 2)
    assert store.truncate_before("t", None, 2) == 1
    store.compact()
    store.append(rows(spark, ["c"]))
    store.compact()
    assert listed(store.events()) and store.load_checkpoint("s", "t", None) == 2 and sorted(listed(store.events())) == [(2, None), (3, None)]


def test_large_truncate(spark):
    e = spark.range(1, 30_001).select(F.lit("m").alias("dest_kind"), F.lit("d").alias("dest_logical"), F.lit("t").alias("topic"), F.lit(None).cast("string").alias("key"), F.col("id").alias("seq"))
    bound = spark.createDataFrame([("m", "d", "t", None, 25_001)], "dest_kind string, dest_logical string, topic string, key string, bound long")
    assert cursor.removed(e, spark.createDataFrame([], schemas.TRUNCATION), bound).first().removed == 25_000


def test_conflict(spark, store):
    store.append(rows(spark, ["a"]))
    with pytest.raises(errors.Conflict) as e:
        store._commit(1, kind="append")
    assert e.value.is_retryable() and errors.Backend("It Would Block").is_retryable() and not errors.Internal("would block").is_retryable()
    # another writer takes the version between planning and commit: the append plans again
    real, taken = store._commit, []

    def racing(version, **what):
        if not taken:
            taken.append(LogStore(spark, store.path).append(rows(spark, ["b"])))
        real(version, **what)

    store._commit = racing
    assert seqs(store.append(rows(spark, ["c"]))) == [3]
    assert sorted(r.event_id for r in store.events().collect()) == ["a", "b", "c"]


def test_micro_batch_replay(spark, store):
    assert seqs(store.append(rows(spark, ["a", "b"]), source="q/0")) == [1, 2]
    assert seqs(store.append(rows(spark, ["a", "b"]), source="q/0")) == [1, 2]
    assert store.version() == 1


def test_snapshots_and_odd_topics(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tidemark.sources.store.SNAPSHOT", 2)
    s = LogStore(spark, str(tmp_path / "log"))
    for topic in ("01", "a/b=c %", "1.0", "01", "zz"):
        s.append(rows(spark, ["a", "b"], topic=topic))
    assert s._versions("_snapshots") == [2, 4] and s._versions("feed") == [1, 2, 3, 4, 5]
    assert {r.topic: r.n for r in s.events().groupBy("topic").agg(F.count("*").alias("n")).collect()} == dict.fromkeys(("01", "a/b=c %", "1.0", "zz"), 2)
    # a writer that died after its commit: the next one publishes it
    (tmp_path / "log" / "feed" / f"{5:020d}.json").unlink()
    s.append(rows(spark, ["c"], topic="zz"))
    assert s._versions("feed") == [1, 2, 3, 4, 5, 6] and listed(s.read_from("zz", None, 2, 9)) == [(3, None)]


def test_none_policy(spark, tmp_path):
    s = LogStore(spark, str(tmp_path / "x"), by_topic={"loose": "none"})
    assert seqs(s.append(rows(spark, ["a", "a"], topic="loose"))) == [1, 2]
    assert seqs(s.append(rows(spark, ["a"], topic="loose"))) == [3]


def test_hot_stream_in_pieces(spark):
    r = workload.records(spark, 2000, "t").withColumn("ordinal", F.col("ordinal") * 3 + 7)
    got = log.plan_append(r, buckets=13)
    assert got.where("seq <> (ordinal - 7) / 3 + 1 or not is_new").count() == 0


def test_attempt_range(spark):
    ok = rows(spark, ["a"]).withColumn("attempt", F.lit(4_294_967_295))
    log.validate(ok)
    with pytest.raises(errors.Validation):
        log.validate(ok.withColumn("attempt", F.lit(4_294_967_296)))


def test_telemetry(spark, store, monkeypatch):
    lines = []
    s = Instrumented(store, ConsoleSink(lines.append))
    s.append(rows(spark, ["a"], key="k"))
    assert listed(s.read_from("t", "k", 0, 5)) == [(1, "k")]
    s.read_from_topic("t", None, 0, 5)
    s.commit_checkpoint("s", "t", "k", 1)
    s.load_checkpoint("s", "t", "k")
    s.truncate_before("t", "k", 1)
    with pytest.raises(errors.Validation):
        s.read_from("t", "k", 0, 20_000)
    assert s.sink.counts == {"append": 1, "read": 2, "checkpoint": 1, "truncate": 1, "error": 1} and "stream=t/k" in lines[1] and "stream=t " in lines[2]
    for value, kind in (("off", NoSink), ("0", NoSink), ("FALSE", NoSink), ("none", NoSink), ("yes", ConsoleSink), ("", ConsoleSink)):
        monkeypatch.setenv("TIDEMARK_TELEMETRY", value)
        assert type(sink_from_env()) is kind
