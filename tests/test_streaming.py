import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_store import rows
from tidemark import schemas
from tidemark.sources.store import LogStore
from tidemark.streaming import ingest as S


def put(spark, path, ids, topic="t"):
    rows(spark, ids, topic=topic).write.mode("append").parquet(path)


def source(spark, path):
    return spark.readStream.schema(rows(spark, []).schema).parquet(path)


def collected(stream, tmp_path, name):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name).collect()


def test_ingest_twice_and_tail(spark, tmp_path):
    src, store = str(tmp_path / "in"), LogStore(spark, str(tmp_path / "log"))
    put(spark, src, ["a", "b", "b"])
    for more in ([], ["c", "a"]):
        if more:
            put(spark, src, more)
        S.run_to_end(lambda: S.ingest(source(spark, src), store, str(tmp_path / "cp"), "q"))
    S.run_to_end(lambda: S.ingest(source(spark, src), store, str(tmp_path / "cp"), "q"))
    assert sorted((r.seq, r.event_id) for r in store.events().collect()) == [(1, "a"), (2, "b"), (3, "c")]
    seen = []
    follow = lambda: S.run_to_end(lambda: S.tail(store, lambda df, i: seen.extend(sorted(r.seq for r in df.collect())), str(tmp_path / "tail"), "tail_rows"))
    follow()
    assert seen == [1, 2, 3]
    # data that was never committed isn't delivered, and compaction delivers nothing again
    (tmp_path / "log" / "events" / "append=lost").mkdir()
    store._read([f"events/{p.name}" for p in (tmp_path / "log" / "events").iterdir() if p.name != "append=lost"], schemas.STORED).write.mode("overwrite").parquet(str(tmp_path / "log" / "events" / "append=lost"))
    store.compact()
    follow()
    assert seen == [1, 2, 3]
    store.append(rows(spark, ["z"]))
    follow()
    assert seen == [1, 2, 3, 4]


def test_replay_after_compaction(spark, tmp_path):
    store = LogStore(spark, str(tmp_path / "log"), default_mode="none")
    for i in range(3):
        store.append(rows(spark, ["a", "a"]), source=f"q/{i}")
    store.append(rows(spark, ["x"]), source="by-hand")
    store.compact()
    store.compact()
    for source in ("q/2", "q/0", "by-hand"):
        store.append(rows(spark, ["a", "a"]), source=source)
    assert store.events().count() == 7
    store.append(rows(spark, ["a", "a"]), source="q/3")
    assert store.events().count() == 9


def test_route_loses_nothing(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [("a", "x", None), ("b", "nowhere", None), ("c", "x", None)])
    stores, rest = {"x": LogStore(spark, str(tmp_path / "x"))}, LogStore(spark, str(tmp_path / "rest"))
    with pytest.raises(StreamingQueryException, match="without a store"):
        S.route(source(spark, src), F.col("topic"), stores, str(tmp_path / "cp"), "r").awaitTermination()
    assert stores["x"].events().count() == 0
    S.route(source(spark, src), F.col("topic"), stores, str(tmp_path / "cp"), "r", rest).awaitTermination()
    assert stores["x"].events().count() == 2 and [r.event_id for r in rest.events().collect()] == ["b"]


def test_route(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, [("a", "x", None), ("b", "y", None), ("c", "x", None)])
    stores = {n: LogStore(spark, str(tmp_path / n)) for n in "xy"}
    S.route(source(spark, src), F.col("topic"), stores, str(tmp_path / "cp"), "r").awaitTermination()
    assert [stores[n].events().count() for n in "xy"] == [2, 1]


def test_dedupe_and_windows(spark, tmp_path):
    src = str(tmp_path / "in")
    put(spark, src, ["a", "b", "a"])
    assert sorted(r.event_id for r in collected(S.deduped(source(spark, src)), tmp_path, "dd")) == ["a", "b"]
    q = S.windowed(source(spark, src), "5 minutes").writeStream.format("memory").queryName("ww").outputMode("complete").option("checkpointLocation", str(tmp_path / "w")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.events for r in spark.table("ww").collect()] == [3]


def test_sequencer(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    src = str(tmp_path / "in")
    put(spark, src, [("a", "x", "k"), ("b", "x", None), ("c", "x", "k")])
    got = sorted((r.topic, r.key, r.seq) for r in collected(S.sequenced(source(spark, src)), tmp_path, "sq"))
    assert got == [("x", "", 1), ("x", "k", 1), ("x", "k", 2)]
