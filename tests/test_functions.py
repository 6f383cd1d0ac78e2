import json

import pytest
from pyspark.sql import functions as F

from tidemark import errors
from tidemark.functions import codec, metrics, routing
from tidemark.operators import matrix, projection
from tidemark.sources import reports


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_routing(spark):
    rules = [("m", "short"), ("metrics.", "long"), ("metrics.", "again"), ("metrics.cache", "longest")]
    for topic, want in (("metrics.cache_hits", "longest"), ("metrics.x", "long"), ("mail", "short"), ("other", "rest")):
        assert one(spark, routing.longest_prefix(F.lit(topic), rules, "rest")) == want
    cells = [f"cell-{i}" for i in range(4)]
    assert one(spark, routing.by_hash(F.lit("user-42"), cells)) == one(spark, routing.by_hash(F.lit("user-42"), cells))
    assert one(spark, routing.by_hash(F.lit(None).cast("string"), cells)) == "cell-0"
    spread = spark.range(400).select(routing.cell(F.concat(F.lit("u"), F.col("id").cast("string")), 4).alias("c")).groupBy("c").count().collect()
    assert len(spread) == 4 and min(r["count"] for r in spread) > 60
    with pytest.raises(errors.Internal):
        routing.by_hash(F.lit("a"), [])
    r = routing.Registry().register("memory:a", 1).register("memory:a", 2)
    assert r.resolve("memory:a") == 2 and r.resolve_stream(lambda t, k: "memory:a", "t") == 2
    with pytest.raises(errors.Internal):
        r.resolve("memory:b")
    routing.Registry.set_global(r)
    routing.Registry.set_global(routing.Registry())
    assert routing.Registry.get_global() is r


def test_codec(spark):
    sk = codec.storage_key(F.lit("tikv_raw"), F.lit("main"), F.lit("t"), F.lit(None).cast("string"))
    assert one(spark, sk) == "tikv:main\x1ft\x1f" and one(spark, codec.key_of(sk)) is None
    assert one(spark, codec.storage_key(F.lit("memory"), F.lit("m"), F.lit("a\x1fb"), F.lit("c"))) is None
    assert one(spark, codec.checkpoint_key(F.lit("s"), F.lit("k"))) == "s\x00k"
    assert one(spark, codec.seq_of(codec.event_key(F.lit("k"), F.lit(12)))) == 12


def test_percentiles_and_slopes(spark):
    d = spark.range(1, 101).select(F.col("id").cast("double").alias("v"), "id")
    assert tuple(metrics.nearest_rank(d, "v", [50, 95, 99]).first()) == (51.0, 95.0, 99.0)
    assert metrics.nearest_rank(d.where("id < 0"), "v", [50]).count() == 1 and metrics.nearest_rank(d.where("id < 0"), "v", [50]).first()[0] == 0.0
    assert metrics.slope_vs_index(d, "v", "id").first()[0] == pytest.approx(1.0)
    assert metrics.slope_vs_index(d.limit(1), "v", "id").first()[0] == 0.0
    assert metrics.decile_p95_slope(d, "v", "id").first()[0] == pytest.approx(10.0)
    assert metrics.decile_p95_slope(d.where("id < 20"), "v", "id").first()[0] == 0.0


def test_scaling_fixture(spark):
    rows = [("a-scylla-2n.json", "5000.0", None), ("b.json", "3318.0", "scylla-1"), ("c-scylla-2n.json", "5000.0", None), ("custom.json", "9000.0", "custom")]
    r = spark.createDataFrame([(f, "bm-m4", "scylla", "aws-t3-medium", t, None, {"achieved_ops_per_sec": o, "client_count": "8"}) for f, o, t in rows], "file string, experiment_id string, storage string, hardware string, scylla_topology string, tikv_topology string, metrics map<string,string>")
    got = projection.scaling_curve(r, "aws-t3-medium", "scylla").orderBy("nodes").collect()
    assert [(x.topology, x.file) for x in got] == [("scylla-1", "b.json"), ("scylla-2n", "a-scylla-2n.json")] and got[0].clusters_for_target == 200_000 and got[0].nodes_for_target == 400_000
    with pytest.raises(errors.Unsupported):
        projection.scaling_curve(r, "x", "mem")
    f = spark.createDataFrame([(10_000.0, None, None, None, None, 0.0416, None)], "per_shard double, aggregate double, cluster_peak double, partitions long, clients long, hourly double, nodes long")
    assert projection.fleet(f).first().partitions_for_target == 100_000


def test_reports(spark, tmp_path):
    def doc(name, **kw):
        (tmp_path / name).write_text(json.dumps({"experiment_id": "bm-l1", "dimensions": {"storage": "mem", "telemetry": "off", "hardware": "dev-wsl"}, "status": "completed", "metrics": {"p99_ms": 1.5, "achieved_ops_per_sec": 120, "error_rate": 0.0, "hot_stream": True}} | kw, indent=1))

    doc("a.json")
    doc("b.json", metrics={}, status="failed")
    (tmp_path / "curve.json").write_text('{"points": [1]}')
    (tmp_path / "broken.json").write_text('{"experiment_id": ')
    r = reports.load(spark, str(tmp_path))
    assert r.count() == 3 and reports.usable(r).count() == 2
    got = {x.experiment_id: x.results for x in reports.results(reports.usable(r)).collect()}
    assert got == {"bm-l1": "p99=1.500ms 120/s err=0.0000% PASS (mem/off)"}
    text = "| BM-L1 | load | old |\n| BM-C0 | x | old |\n| plain | x | old |"
    assert reports.fill(text, got).split("\n") == [f"| BM-L1 | load | {got['bm-l1']} |", "| BM-C0 | x | — |", "| plain | x | old |"]


@pytest.mark.parametrize(("name", "n"), [("full", 80), ("sql", 17), ("tikv-lab-colocated", 51), ("tikv-topology", 6), ("surreal-scale", 6), ("tikv-projection-inputs", 4), ("native-lab", 27), ("native-lab-partitioned", 12), ("native-scale", 10), ("native-concurrency", 2), ("native-projection-inputs", 10), ("native-topology", 20)])
def test_matrices(spark, name, n):
    assert matrix.subset(spark, name).count() == n


def test_matrix_filters(spark):
    runs = matrix.full(spark).withColumn("file", reports.file_name())
    done = runs.limit(3).select("file")
    assert matrix.filtered(runs, existing=done).count() == 77
    with pytest.raises(errors.Validation):
        matrix.subset(spark, "none")


def test_stress_logs(spark):
    total = "TOTAL  - Takes(s): 9.9, Count: {}, OPS: {}, Avg(us): 99, 90th(us): 1, 95th(us): {}, 99th(us): 9".format
    logs = {
        "cassandra": ["Running with 4 threadCount", "Op rate                   :   12,345 op/s  [WRITE: 12,345 op/s]", "Latency 95th percentile   :    1.5 ms [WRITE: 1.5 ms]", "Running with 8 threadCount", "Op rate : 20,000.5 op/s", "Latency 95th percentile : 2.5 ms", "Running with 16 threadCount", "Op rate : 20,000.5 op/s", "Latency 95th percentile : 9.5 ms"],
        "uneven": ["Running with 4 threads", "Running with 8 threads", "latency 95TH percentile : 7.5 ms", "latency 95th percentile : 3.0 ms", "Op rate : 1 op/s", "Op rate : 2 op/s", "Op rate : 3 op/s"],
        "auto": ["Running with 4 threadCount", "total,        1000,    1000,    1000,    1000,     0.9", "total,        9000,    8000,    8000,    8000,     0.9", "Latency 95th percentile : 4.0 ms"],
        "best": ["--- threadcount=4 ---", total(100000, 99, 800), "BEST_THREADS=32", "BEST_OPS_PER_SEC=4321.5", "BEST_P95_US=2500"],
        "sweep": ["BEST_THREADS=0", "BEST_OPS_PER_SEC=0", "--- threadcount=4 ---", total(100000, 500.5, 800), total(100000, 9999, 1), "--- threadcount=8 ---", total(99, 8000, 5), "--- threadcount=16 ---", "READ   - Takes(s): 9", total(100000, 700.5, 1200)],
        "bare": ["INSERT - x", total(100000, 600, 1000), total(100000, 650, 2000), total(50000, 999, 1)],
        "short": ["--- threadcount=4 ---", total(99, 500, 800)],
        "none": ["nothing", "Running with 3 threads"],
    }
    d = spark.createDataFrame([(k, i, x) for k, v in logs.items() for i, x in enumerate(v)], "log string, place long, text string")
    assert {r.log: tuple(r)[1:] for r in projection.stress_peak(d).collect()} == {
        "cassandra": (20000.5, 8, 2.5), "uneven": (3.0, 8, 7.5), "auto": (8000.0, 4, 4.0), "best": (4321.5, 32, 2.5),
        "sweep": (700.5, 16, 1.2), "bare": (650.0, None, 2.0), "short": (None, None, None), "none": (None, 3, None),
    }
