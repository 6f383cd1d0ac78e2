"""Experiment matrices as cross products of small fixed dimensions, their filters, and why a run is skipped."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import errors

#: Experiments in their order, and the default storages.
EXPERIMENTS = [*(f"bm-c{i}" for i in range(7)), *(f"bm-l{i}" for i in range(4)), "bm-p1", "bm-p2", *(f"bm-m{i}" for i in range(1, 6))]
STORAGES = ["mem", "surreal-mem", "surreal-rocksdb", "sqlite"]
BOTH = ("bm-c0", "bm-l1")
TIKV_LAB = ["tikv-minimal", "tikv-ha-2", "tikv-ha-3"]
LAB = [*(f"bm-c{i}" for i in range(5)), *(f"bm-l{i}" for i in range(4))]
LOAD = [f"bm-l{i}" for i in range(4)]
SCALE = ["bm-p1", "bm-p2", "bm-m1", "bm-m2", "bm-m4"]
INPUTS = [*LOAD, "bm-m2"]


def _product(spark: SparkSession, experiments: list[str], storages: list[str], **fixed) -> DataFrame:
    """experiment x storage, with both orders; the sides are literals of a dozen values."""
    rows = spark.range(1).select(F.posexplode(F.array(*(F.lit(e) for e in experiments))).alias("_e", "experiment_id")).select("_e", "experiment_id", F.posexplode(F.array(*(F.lit(s) for s in storages))).alias("_s", "storage"))
    topology = F.when(F.col("experiment_id") == "bm-c5", "shared-handle").otherwise("isolated-lab")
    out = rows.withColumns({"topology": topology, "telemetry": F.lit("off"), "hardware": F.lit("dev-wsl"), "tikv_topology": F.lit(None).cast("string"), "scylla_topology": F.lit(None).cast("string"), "surreal_instances": F.lit(1)})
    return out.withColumns({k: F.lit(v) for k, v in fixed.items()})


def full(spark: SparkSession, hardware: str = "dev-wsl", remote_surreal: bool = False, postgres: bool = False) -> DataFrame:
    """All experiments on the default storages, console telemetry too for two of them; remote and postgres runs where they can be had."""
    def both(d):
        return d.withColumn("telemetry", F.explode(F.when(F.col("experiment_id").isin(*BOTH), F.array(F.lit("off"), F.lit("console"))).otherwise(F.array(F.lit("off")))))

    out = both(_product(spark, EXPERIMENTS, STORAGES, hardware=hardware))
    if remote_surreal:
        out = out.unionByName(_product(spark, [e for e in EXPERIMENTS if e != "bm-c5"], ["surreal-mem"], hardware=hardware, topology="remote-surreal"))
    if postgres:
        out = out.unionByName(both(_product(spark, EXPERIMENTS, ["postgres"], hardware=hardware)))
    return out


def subset(spark: SparkSession, name: str, hardware: str = "dev-wsl", native: tuple[str, ...] = ("sqlite", "scylla", "tikv-raw"), postgres: bool = False, instances: int = 1, tikv: str = "tikv-ha-3") -> DataFrame:
    """One of the named subsets. native: the storages that can be reached."""
    remote = [s for s in native if s != "sqlite"]
    surreal = lambda exps, **kw: _product(spark, exps, ["surreal-tikv"], hardware=hardware, topology="remote-surreal", **kw)
    own = lambda exps, storages: _product(spark, exps, storages, hardware=hardware)

    def union(parts):
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    made = {
        "full": lambda: full(spark, hardware, postgres=postgres),
        "sql": lambda: own([e for e in EXPERIMENTS if e != "bm-c6"], ["sqlite", *["postgres"] * postgres]),
        "tikv-lab-colocated": lambda: union([surreal([e for e in EXPERIMENTS if e != "bm-c5"], tikv_topology=t, surreal_instances=instances) for t in TIKV_LAB]),
        "tikv-topology": lambda: union([surreal(["bm-l1", "bm-l2"], tikv_topology=t) for t in TIKV_LAB]),
        "surreal-scale": lambda: union([surreal(["bm-l1", "bm-l2"], tikv_topology=tikv, surreal_instances=n) for n in (1, 2, 4)]),
        "tikv-projection-inputs": lambda: surreal(LOAD, tikv_topology=tikv, surreal_instances=instances),
        "native-lab": lambda: own(LAB, list(native)),
        "native-lab-partitioned": lambda: own(LOAD, list(native)),
        "native-scale": lambda: own(SCALE, remote),
        "native-concurrency": lambda: own(["bm-m3"], remote),
        "native-projection-inputs": lambda: own(INPUTS, remote),
        "native-topology": lambda: union([own(INPUTS, remote), own(SCALE, remote)]),
    }
    if name not in made:
        raise errors.Validation(f"no matrix {name}")
    return made[name]()


def filtered(runs: DataFrame, storages: list[str] | None = None, skip: list[str] = (), start: str | None = None, topology: str | None = None, existing: DataFrame | None = None) -> DataFrame:
    """Runs by storage, without some experiments, from one experiment on, by topology, and without those whose report ``file`` exists."""
    if storages:
        runs = runs.where(F.col("storage").isin(*storages))
    if skip:
        runs = runs.where(~F.col("experiment_id").isin(*skip))
    if start:
        runs = runs.where(F.array_position(F.array(*(F.lit(e) for e in EXPERIMENTS)), F.col("experiment_id")) > EXPERIMENTS.index(start))
    if topology:
        runs = runs.where(F.col("topology") == topology)
    return runs if existing is None else runs.join(existing, "file", "left_anti")


def skip_status(runs: DataFrame, remote: bool, postgres: bool = False) -> DataFrame:
    """Adds ``status``: skipped where a run is unsupported or needs a service that isn't there, else null."""
    unsupported = (F.col("experiment_id") == "bm-c5") & ~F.col("storage").startswith("surreal") & (F.col("storage") != "mem") & (F.col("storage") != "sqlite")
    absent = ((F.col("topology") == "remote-surreal") & F.lit(not remote)) | ((F.col("storage") == "postgres") & F.lit(not postgres))
    return runs.withColumn("status", F.when(unsupported, "skipped_unsupported").when(absent, "skipped_no_remote"))
