"""Run reports: a folder of JSON documents in, rows out; and file names, result lines and markdown."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import rules
from tidemark.operators.projection import metric

SCHEMA = T.StructType([
    T.StructField("experiment_id", T.StringType()),
    T.StructField("dimensions", T.StructType([*(T.StructField(c, T.StringType()) for c in ("storage", "topology", "telemetry", "hardware", "tikv_topology", "scylla_topology", "surreal_deployment")), T.StructField("surreal_instances", T.LongType())])),
    *(T.StructField(c, T.StringType()) for c in ("engine_path", "started_at", "pass_criteria", "status", "notes")),
    T.StructField("elapsed_secs", T.DoubleType()), T.StructField("pass", T.BooleanType()), T.StructField("metrics", T.MapType(T.StringType(), T.StringType())), T.StructField("_corrupt_record", T.StringType()),
])


def load(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each report. Files that can't be parsed have _corrupt_record; derived documents, without an experiment, are left out."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", "*.json").json(folder)
    d = raw.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return d.where("experiment_id is not null or _corrupt_record is not null").select("*", "dimensions.*").drop("dimensions")


def usable(reports: DataFrame) -> DataFrame:
    return reports.where("_corrupt_record is null").drop("_corrupt_record")


def file_name(tags: list[Column | str] = ()) -> Column:
    """A report's name from its dimensions and tags."""
    c = F.col
    start = F.when(c("storage") == "surreal-tikv", F.concat_ws("-", "experiment_id", "storage", F.coalesce("tikv_topology", F.lit("tikv-unknown"))))
    start = start.when(c("storage") == "scylla", F.concat_ws("-", "experiment_id", "storage", F.coalesce("scylla_topology", F.lit("scylla-1")), "topology"))
    start = start.when(c("storage") == "tikv-raw", F.concat_ws("-", "experiment_id", "storage", F.coalesce("tikv_topology", F.lit("tikv-minimal")), "topology"))
    start = start.otherwise(F.concat_ws("-", "experiment_id", "storage", "topology"))
    return F.concat(F.concat_ws("-", start, "telemetry", "hardware", *tags), F.lit(".json"))


def results(reports: DataFrame, nan: str = "NaN") -> DataFrame:
    """experiment_id and its completed runs' lines, in file order; ``nan`` is how a line spells 0/0."""
    line = rules.result_line(F.col("experiment_id"), metric, rules.passed(F.col("experiment_id"), metric), nan)
    rows = reports.where("status = 'completed'").select("experiment_id", F.struct("file", F.concat(line, F.lit(" ("), "storage", F.lit("/"), "telemetry", F.lit(")")).alias("line")).alias("r"))
    return rows.groupBy("experiment_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "; ").alias("results"))


def fill(markdown: str, results_by_id: dict[str, str]) -> str:
    """A markdown table with its last column filled for the rows that start with an experiment's id; a dash where there is no result."""
    out = []
    for line in markdown.split("\n"):
        cells = line.split("|")
        name = cells[1].strip(" `").lower() if len(cells) > 3 else ""
        if name.startswith("bm-"):
            cells[-2] = f" {results_by_id.get(name, '—')} "
            line = "|".join(cells)
        out.append(line)
    return "\n".join(out)
