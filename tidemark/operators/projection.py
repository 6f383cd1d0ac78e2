"""Scaling curves, fleet projections and campaign tables over flat run reports.

A report row has ``file``, ``experiment_id``, ``status``, the dimensions (storage, hardware, scylla_topology, tikv_topology, surreal_instances),
``notes`` and ``metrics`` (map of name to text), see ``sources.reports``.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark import errors

#: Storage nodes by topology, hourly prices by hardware (USD), the fleet's target rate, hours of a month and the targets of the cost table.
NODES = {
    "scylla-1": 1, "scylla-2n": 2, "scylla-3n": 3, "scylla-4n": 4,
    "tikv-minimal": 1, "tikv-ha-2": 2, "tikv-ha-3": 3, "tikv-scale-4": 4, "tikv-scale-5": 5,
}
HOURLY = {
    "dev-wsl": 0.0, "ci-small": 0.0, "bare-metal-small": 0.05, "bare-metal-medium": 0.10, "bare-metal-large": 0.25, "aws-t3-small": 0.0208, "aws-t3-medium": 0.0416,
    "aws-t4g-small": 0.0168, "aws-t4g-medium": 0.0336, "aws-t4g-large": 0.0672, "aws-c7i-4xlarge": 0.816, "aws-i4i-xlarge": 0.312,
}
TARGET = 1_000_000_000.0
MONTH = 730
TARGETS = [10_000, 50_000, 100_000, 1_000_000]
BASELINE = {"scylla": "scylla-1", "tikv-raw": "tikv-minimal"}


def metric(name: str) -> Column:
    """A number from the metrics; true counts as 1."""
    text = F.col("metrics")[name]
    return F.when(text == "true", 1.0).when(text == "false", 0.0).otherwise(text.try_cast("double"))


def lookup(column: Column, table: dict) -> Column:
    """A small fixed table as an expression, so that no join is needed; null for other values."""
    out = F.lit(None).cast("double")
    for k, v in table.items():
        out = F.when(column == k, float(v)).otherwise(out)
    return out


def topology(storage: str) -> Column:
    """The report's own field, else the slug in the file's name, else the smallest one."""
    field = "scylla_topology" if storage == "scylla" else "tikv_topology"
    slugs = [k for k in sorted(NODES, reverse=True) if k.startswith("scylla" if storage == "scylla" else "tikv")]
    found = F.regexp_extract("file", "(" + "|".join(slugs) + ")", 1)
    return F.coalesce(F.col(field), F.when(found != "", found), F.lit(BASELINE[storage]))


def scaling_curve(reports: DataFrame, hardware: str, storage: str) -> DataFrame:
    """For each topology its best rate (the first file's on ties), against the smallest topology and per node, and the nodes that the target rate takes."""
    if storage not in BASELINE:
        raise errors.Unsupported(f"no scaling curve for {storage}")
    own = reports.where((F.col("experiment_id") == "bm-m4") & (F.col("hardware") == hardware) & (F.col("storage") == storage))
    rate = F.coalesce(metric("achieved_ops_per_sec"), F.lit(0.0))
    rows = own.select(topology(storage).alias("topology"), rate.alias("ops"), F.coalesce(metric("client_count"), F.lit(0.0)).cast("long").alias("clients"), metric("p99_ms").alias("p99_ms"), "file")
    best = rows.groupBy("topology").agg(F.min_by(F.struct("ops", "clients", "p99_ms", "file"), F.struct(-F.col("ops"), "file")).alias("b"))
    flat = best.select("topology", "b.*").withColumn("nodes", lookup(F.col("topology"), NODES).cast("long")).where("nodes > 0")
    base = F.max(F.when(F.col("topology") == BASELINE[storage], F.col("ops"))).over(Window.partitionBy(F.lit(0)))
    out = flat.withColumn("vs_baseline", F.when(base > 0, F.col("ops") / base)).withColumn("ops_per_node", F.col("ops") / F.col("nodes"))
    top = F.max(F.struct("ops", -F.col("nodes"), "topology")).over(Window.partitionBy(F.lit(0)))
    clusters = F.when(top["ops"] > 0, F.ceil(TARGET / top["ops"])).cast("long")
    return out.withColumn("clusters_for_target", clusters).withColumn("nodes_for_target", clusters * lookup(top["topology"], NODES).cast("long"))


def curve_markdown(curve: DataFrame) -> DataFrame:
    """The curve as table lines in node order."""
    line = F.format_string("| %s | %d | %.0f | %s | %.0f | %d |", "topology", "nodes", "ops", F.coalesce(F.format_string("%.2fx", "vs_baseline"), F.lit("-")), F.bround("ops_per_node", 0), "clients")
    return curve.select("nodes", "topology", line.alias("line")).orderBy("nodes", "topology")


def projection_inputs(reports: DataFrame, hardware: str, storage: str, topo: str | None = None) -> DataFrame:
    """One row: what the reports say for a projection. In the order of files the last rate counts; of the load tiers the third first, then the first of the others."""
    own = reports.where((F.col("hardware") == hardware) & (F.col("storage") == storage))
    if topo is not None:
        own = own.where(F.coalesce("scylla_topology", F.lit("")).eqNullSafe(topo) | F.coalesce("tikv_topology", F.lit("")).eqNullSafe(topo))
    else:
        own = own.where(F.coalesce(metric("load_partition_count"), F.lit(0.0)) <= 1)
    e, rate = F.col("experiment_id"), metric("achieved_ops_per_sec")
    last = lambda value, when: F.max_by(value, F.when(when & value.isNotNull(), F.col("file")))
    wide = e.isin("bm-m2", "bm-m4")
    lower = F.min_by(rate, F.when(e.isin("bm-l0", "bm-l1", "bm-l2") & rate.isNotNull(), F.col("file")))
    return own.agg(
        F.coalesce(last(rate, e == "bm-l3"), lower).alias("per_shard"), last(rate, wide).alias("aggregate"), F.max(F.when(e == "bm-m4", rate)).alias("cluster_peak"),
        last(F.coalesce(metric("partitions_modeled"), metric("partition_count")), wide).cast("long").alias("partitions"), last(F.coalesce(metric("clients_modeled"), metric("client_count")), wide).cast("long").alias("clients"),
        F.coalesce(F.max_by("surreal_instances", F.when(F.col("surreal_instances").isNotNull(), F.col("file"))), F.lit(1)).cast("long").alias("surreal_instances"),
    )


def fleet(inputs: DataFrame) -> DataFrame:
    """Clusters, nodes and cost for the target rate from per_shard, aggregate, cluster_peak, partitions, clients, hourly and nodes.

    cost_per_million is the price of a million operations at the measured rate. reference_cost keeps the older formula, which
    divides the whole fleet's price by one cluster's rate where an aggregate was measured."""
    per = F.when(F.col("per_shard") > 0, F.col("per_shard"))
    parts = F.ceil(TARGET / per).cast("long")
    modelled = per * F.col("partitions") * F.col("clients")
    total = F.coalesce("aggregate", "cluster_peak", modelled)
    d = inputs.withColumns({"partitions_for_target": parts, "aggregate_rate": total})
    clusters = F.coalesce(F.when(F.col("aggregate_rate") > 0, F.ceil(TARGET / F.col("aggregate_rate"))).cast("long"), F.col("partitions_for_target"))
    d = d.withColumns({"clusters_for_target": clusters, "fleet_rate": F.coalesce("aggregate_rate", per * F.col("partitions_for_target"))})
    d = d.withColumn("nodes_for_target", F.col("clusters_for_target") * F.col("nodes"))
    paid = (F.col("fleet_rate") > 0) & (F.col("hourly") > 0)
    used = F.coalesce("nodes_for_target", "clusters_for_target", F.greatest("partitions_for_target", F.lit(1)), F.lit(1))
    one = F.when(F.col("aggregate_rate") > 0, F.coalesce("nodes", F.lit(1)) / F.col("aggregate_rate")).otherwise(1 / per)
    return d.withColumns({"reference_cost": F.when(paid, F.col("hourly") * used / F.col("fleet_rate") * (1e6 / 3600)), "cost_per_million": F.when(paid, F.col("hourly") * one * (1e6 / 3600))})


def ceilings(reports: DataFrame) -> DataFrame:
    """The best rate by hardware, topology, tag in the file's name, and whether idempotency was on."""
    f = F.col("file")
    own = reports.where(F.col("experiment_id").isin("bm-m4", "bm-m5") & (F.col("storage") == "scylla") & F.col("hardware").isNotNull())
    slug = F.regexp_extract(f, "(scylla-4n|scylla-2n|scylla-1)", 1)
    exact = F.regexp_extract(f, r"(ceil-z1(?:on|off)-c[0-9]+)", 1)
    tag = F.when(exact != "", exact).when(f.rlike("z1-treatment-none|z1off"), "ceil-z1off").when(f.rlike("z1-baseline|z1on"), "ceil-z1on").otherwise("")
    on = F.when(f.rlike("ceil-z1on|baseline-lwt"), True).when(f.rlike("ceil-z1off|treatment-none"), False).otherwise(~F.contains(tag, F.lit("off")) & ~F.contains(f, F.lit("none")))
    rows = own.select("hardware", F.coalesce(F.col("scylla_topology"), F.when(slug != "", slug), F.lit("scylla-1")).alias("topology"), F.when(tag != "", tag).otherwise(f).alias("tag"), on.alias("z1_on"), F.coalesce(metric("achieved_ops_per_sec"), F.lit(0.0)).alias("ops"))
    return rows.groupBy("hardware", "topology", "tag", "z1_on").agg(F.max("ops").alias("ops"))


def monthly_cost(peaks: DataFrame, targets: list[int] = TARGETS) -> DataFrame:
    """peaks (hardware, topology, ops, ...) by target: clusters and price of a month; infinite without a rate."""
    each = peaks.withColumn("target", F.explode(F.array(*(F.lit(t).cast("long") for t in targets))))
    clusters = F.when(F.col("ops") > 0, F.ceil(F.col("target") / F.col("ops"))).cast("long")
    price = clusters * lookup(F.col("topology"), NODES) * lookup(F.col("hardware"), HOURLY) * MONTH
    return each.withColumns({"clusters": clusters, "monthly_usd": F.when(F.col("ops") > 0, price).otherwise(float("inf"))})


def index_matrix(reports: DataFrame) -> DataFrame:
    """The best run by topology, variant and index cache, of equal ones the last file; round trips come from the notes."""
    f = F.col("file")
    own = reports.where(F.col("experiment_id").isin("bm-m4", "bm-m5") & (F.col("storage") == "scylla") & f.rlike("idx-z1off-(m4|t8|t64)-l2(on|off)|idx-validate-m4-default"))
    plain = F.contains(f, F.lit("idx-validate-m4-default"))
    pattern = "idx-z1off-(m4|t8|t64)-l2(on|off)"
    trips = F.regexp_extract(F.coalesce("notes", F.lit("")), r"rt_per_append=([0-9.]+)", 1).try_cast("double")
    rows = own.select(F.coalesce("scylla_topology", F.lit("scylla-1")).alias("topology"), F.when(plain, "m4").otherwise(F.regexp_extract(f, pattern, 1)).alias("variant"), F.when(plain, "default").otherwise(F.regexp_extract(f, pattern, 2)).alias("l2"), F.coalesce(metric("achieved_ops_per_sec"), F.lit(0.0)).alias("ops"), trips.alias("rt"), metric("p99_ms").alias("p99_ms"), "file")
    return rows.groupBy("topology", "variant", "l2").agg(F.max_by(F.struct("ops", "rt", "p99_ms", "file"), F.struct("ops", "file")).alias("b")).select("topology", "variant", "l2", "b.*")


def index_verdict(matrix: DataFrame) -> DataFrame:
    """One row: which of the registered findings holds."""
    at = lambda t, v, c: F.coalesce(F.max(F.when((F.col("topology") == t) & (F.col("variant") == v) & (F.col("l2") == c), F.col("ops"))), F.lit(0.0))
    d = matrix.agg(at("scylla-2n", "m4", "off").alias("off2"), at("scylla-2n", "m4", "on").alias("on2"), at("scylla-2n", "t64", "off").alias("t_off2"), at("scylla-2n", "t64", "on").alias("t_on2"), at("scylla-4n", "m4", "off").alias("off4"), at("scylla-1", "m4", "off").alias("off1"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) / F.greatest(F.col(b), F.lit(1.0)) < 0.1
    verdict = F.when((F.col("off2") > 0) & (F.col("t_off2") > 0) & (F.col("t_off2") >= 1.5 * F.col("off2")), "index-partition-confirmed").when((F.col("off2") > 0) & close("on2", "off2"), "index-cache-insufficient").otherwise("mixed")
    return d.withColumns({"verdict": verdict, "per_node_2n": F.when((F.col("off1") > 0) & (F.col("off2") > 0), F.col("off2") / 2), "cache_effective": (F.col("t_on2") > 0) & (F.col("t_off2") > 0) & close("t_on2", "t_off2")})


def track_table(reports: DataFrame) -> DataFrame:
    """Completed runs with the partition and client counts of their files' names."""
    stem = F.regexp_replace("file", r"\.json$", "")
    number = lambda p: F.regexp_extract(stem, p, 1).try_cast("long")
    return reports.where("status = 'completed'").select("experiment_id", "storage", F.coalesce(number(r"^.*-pk([0-9]+)(?:-|$)"), number(r"^.*-k([0-9]+)(?:-|$)")).alias("partitions"), number(r"^.*-c([0-9]+)(?:-|$)").alias("clients"), metric("achieved_ops_per_sec").alias("ops"), "file").orderBy("experiment_id", "storage", F.col("partitions").asc_nulls_first(), F.col("clients").asc_nulls_first(), "file")


def _matches(kind: str, pattern: str):
    return F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.regexp_replace(x, ",", "").alias("value"), F.lit(None).cast("string").alias("p95"), F.lit(None).cast("string").alias("count")))


_TOTAL = r"^TOTAL  - Takes\(s\): [^,]+, Count: ([0-9]+), OPS: ([0-9.]+).*?95th\(us\): ([0-9]+)"


def stress_peak(lines: DataFrame) -> DataFrame:
    """The best rate in each log of cassandra-stress or go-ycsb, with its threads and 95th percentile. lines: log, place, text (one line).

    cassandra-stress: the first of the largest 'Op rate' values, or of those of auto-rate 'total,' lines where there are none. Threads and
    percentile are those of the same number in the log, or else the last threads and the largest percentile. go-ycsb: its BEST_ values, or else
    the best first TOTAL line of 100000 operations after a 'threadcount' line, or of all such lines where no thread count comes before one.
    A log without a rate has nulls."""
    total = F.struct(F.lit("total").alias("kind"), F.regexp_extract("text", _TOTAL, 2).alias("value"), F.regexp_extract("text", _TOTAL, 3).alias("p95"), F.regexp_extract("text", _TOTAL, 1).alias("count"))
    found = F.concat(
        _matches("rate", r"Op rate\s*:\s*([0-9,.]+)\s*op/s"), _matches("auto", r"total,\s*[0-9]+,\s*([0-9,]+),\s*[0-9,]+,\s*[0-9,]+,"), _matches("threads", r"Running with\s*([0-9]+)\s*thread"), _matches("p95", r"(?i)95th percentile\s*:\s*([0-9.]+)\s*ms"),
        _matches("best_ops", r"BEST_OPS_PER_SEC=([0-9.]+)"), _matches("best_threads", r"BEST_THREADS=([0-9]+)"), _matches("best_p95", r"BEST_P95_US=([0-9.]+)"), _matches("count", r"--- threadcount=([0-9]+) ---"),
        F.when(F.col("text").rlike(_TOTAL), F.array(total)).otherwise(F.array().cast("array<struct<kind:string,value:string,p95:string,count:string>>")),
    )
    kind, number = F.col("kind"), F.col("value").try_cast("double")
    items = lines.select("log", "place", F.posexplode(found).alias("j", "item")).select("log", "place", "j", "item.*").withColumn("n", F.row_number().over(Window.partitionBy("log", "kind").orderBy("place", "j")))
    order = Window.partitionBy("log").orderBy("place", "j")
    before = F.lag("kind").over(order)
    runs = items.where("kind in ('count', 'total')").withColumns({"run": (kind == "total") & F.coalesce(before == "count", F.lit(False)), "begun": F.when((kind == "count") & F.coalesce(before != "count", F.lit(True)), F.col("value"))})
    runs = runs.withColumn("threads", F.last("begun", True).over(order).cast("long"))
    full = (kind == "total") & (F.col("count") == "100000")
    first = lambda ok, *columns: F.min_by(F.struct(*columns), F.when(ok, F.struct(-number, "place", "j")))
    best = runs.groupBy("log").agg(F.max("run").alias("any"), first(full & F.col("run"), number.alias("ops"), "threads", F.col("p95").cast("double").alias("us")).alias("r"), first(full, number.alias("ops"), F.lit(None).cast("long").alias("threads"), F.col("p95").cast("double").alias("us")).alias("t"))
    best = best.select("log", F.when(F.col("any"), F.col("r")).otherwise(F.col("t")).alias("run"))
    of = lambda k: F.max(F.when((kind == k) & (F.col("n") == 1), F.col("value")))
    peak = items.groupBy("log").agg(F.coalesce(first(kind == "rate", number.alias("ops"), "n"), first(kind == "auto", number.alias("ops"), "n")).alias("peak"), of("best_ops").alias("b_ops"), of("best_threads").alias("b_threads"), of("best_p95").alias("b_us"))
    at = lambda k: F.max(F.when((kind == k) & (F.col("n") == F.coalesce("peak.n", F.lit(1))), number))
    near = items.join(peak.select("log", "peak"), "log").groupBy("log").agg(F.coalesce(at("threads"), F.max_by(number, F.when(kind == "threads", F.col("n")))).alias("threads"), F.coalesce(at("p95"), F.max(F.when(kind == "p95", number))).alias("p95_ms"))
    d = lines.select("log").distinct().join(peak, "log", "left").join(near, "log", "left").join(best, "log", "left")
    ycsb = F.col("peak").isNull() & (F.coalesce("b_ops", "b_threads", "b_us").isNotNull() | F.col("run").isNotNull())
    given = F.when(F.col("b_ops") != "0", F.col("b_ops").try_cast("double"))
    use = given.isNull() & F.col("run").isNotNull()
    us = F.when(use, F.col("run.us")).otherwise(F.col("b_us").try_cast("double"))
    return d.select("log", F.when(ycsb, F.coalesce(given, F.col("run.ops"))).otherwise(F.col("peak.ops")).alias("ops"), F.when(ycsb, F.when(use, F.col("run.threads")).when(F.col("b_threads") != "0", F.col("b_threads").cast("long"))).otherwise(F.col("threads").cast("long")).alias("threads"), F.when(ycsb, F.when(us != 0, us / 1000)).otherwise(F.col("p95_ms")).alias("p95_ms"))


def sweep_stop(steps: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds why a sweep stops after a step, or null: errors, cpu, memory, or a gain under a tenth over the step before. Columns ops, error_rate, cpu_pct, rss_gib."""
    before = F.lag("ops").over(Window.partitionBy(*by).orderBy(order))
    gain = (F.col("ops") - before) / before
    why = F.when(F.col("error_rate") >= 0.01, "errors").when(F.col("cpu_pct") >= 85, "cpu").when(F.col("rss_gib") >= 3.5, "memory").when((before > 0) & (gain < 0.10), "gain")
    return steps.withColumn("stop", why)


def publishers(reports: DataFrame, by: list[str]) -> DataFrame:
    return reports.groupBy(*by).agg(F.sum(F.coalesce(metric("achieved_ops_per_sec"), F.lit(0.0))).alias("ops"), F.count("*").alias("publishers"))
