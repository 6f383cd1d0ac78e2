"""Folders that driver and executors share, and session settings of the operators."""

import atexit
import contextlib
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows in one Arrow batch: a batch of ordinary documents is then a few MB.
ARROW_ROWS = 1024


def session(spark: SparkSession) -> SparkSession:
    """Keeps Arrow batches small, so that long texts come in batches of a few rows; a session that has its own settings keeps them."""
    there = spark.conf.getAll
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS)), ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")):
        if key not in there:
            spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; where it is unset on a single machine, as in tests, a folder is made for this process."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if own:
        return own.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    global _local
    _local = _local or tempfile.mkdtemp(prefix="tidemark-")
    return f"file://{_local}"


_local = ""
_written: dict[str, SparkSession] = {}


def written(df: DataFrame, name: str, instead: DataFrame | None = None) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts the lineage, and a lost executor costs no recomputation.

    ``instead`` is a table of the same kind that isn't needed any more; it is removed. What is left is removed when the process ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_clean)
    _written[path] = spark
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    if (old := getattr(instead, "written_to", None)) in _written:
        _remove(_written.pop(old), old)
    return out


def _remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def _clean() -> None:
    """Removes what this process wrote, as far as its sessions still live."""
    for path, spark in _written.items():
        with contextlib.suppress(Exception):
            _remove(spark, path)


def own(*frames: DataFrame) -> str:
    """A prefix that no column of the frames begins with, whatever its case: for an operator's own columns beside the user's."""
    taken, name = [c.lower() for f in frames for c in f.columns], "own_"
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")
