"""A log in a folder: Parquet data, and commits that are created exclusively.

A commit is a JSON line in ``_commits/<version>.json`` that names the data it adds; readers see only what commits name, so data of a writer
that died is never read. Two writers that plan against one version can't both create the next one: the second gets Conflict and plans again.
Every SNAPSHOT commits, those in force are written together, so that no operation reads the whole history. A whole commit is also published
in ``feed``, which streams follow; a writer publishes what others before it didn't get to. All paths go through Spark's file systems.

Events lie in folders by topic, sorted by key and sequence; a long stream is dealt out in stretches of STRETCH sequences. What an append reads
of earlier ids is limited to the batch's topics and its range of ids, which file statistics serve where ids grow with time.
"""

import json
import time
import uuid
from collections.abc import Callable
from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark import errors, schemas
from tidemark.operators import cursor, log
from tidemark.schemas import JOIN, STREAM, keyed

#: What a commit can say, by the kind of commit: paths of data, the micro-batches it holds, and the version that a compaction replaces.
FIELDS = ("version", "kind", "events", "heads", "rows", "ids", "checkpoints", "source", "sources", "replaces")
FEED = T.StructType([T.StructField("version", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("events", T.StringType())])
SNAPSHOT = 64
STRETCH = 1 << 20
#: Rows of one stream above which it is numbered in pieces.
HOT_STREAM = 5_000_000
TRIES = 8


def _split(source: str) -> tuple[str, int]:
    """A micro-batch's query and number."""
    name, slash, i = source.rpartition("/")
    return (name, int(i)) if slash and i.isdecimal() else (source, -1)


class LogStore:
    """The six operations of a log. Streams are given as topic and key within the store's destination."""

    def __init__(self, spark: SparkSession, path: str, kind: str = "memory", logical: str = "default", by_topic: dict[str, str] | None = None, default_mode: str = "lwt") -> None:
        self.spark, self.path, self.kind, self.logical = spark, path.rstrip("/"), kind, logical
        self.by_topic, self.default_mode = by_topic, default_mode
        self._fs_path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._fs_path(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        for folder in ("_commits", "_snapshots", "feed"):
            self._fs.mkdirs(self._fs_path(f"{self.path}/{folder}"))

    # commits

    def _versions(self, folder: str) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._fs_path(f"{self.path}/{folder}"))]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit())

    def version(self) -> int:
        return max(self._versions("_commits"), default=0)

    def _lines(self, folder: str, version: int) -> list[SimpleNamespace]:
        """The commits in a file. One that is just being written is waited for."""
        path = self._fs_path(self._file(folder, version))
        for wait in range(8):
            stream = self._fs.open(path)
            try:
                text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if text.endswith("\n"):
                return [SimpleNamespace(**dict.fromkeys(FIELDS) | json.loads(line)) for line in text.splitlines()]
            time.sleep(0.05 * 2**wait)
        raise errors.Backend(f"{path.toString()} was never written to its end")

    def _file(self, folder: str, version: int) -> str:
        return f"{self.path}/{folder}/{version:020d}.json"

    def _commits(self, version: int) -> list[SimpleNamespace]:
        """Commits that hold at a version: those before the last compaction are in it."""
        base = max((v for v in self._versions("_snapshots") if v <= version), default=0)
        rows = self._lines("_snapshots", base) if base else []
        for v in range(base + 1, version + 1):
            rows += self._lines("_commits", v)
        start = max((r.replaces for r in rows if r.replaces is not None), default=0)
        return [r for r in rows if r.version > start and (r.replaces is None or r.replaces == start)]

    def _put(self, folder: str, version: int, text: str) -> None:
        """A file that is there only once it is whole."""
        part, target = self._fs_path(f"{self.path}/{folder}/_{uuid.uuid4().hex}"), self._fs_path(self._file(folder, version))
        out = self._fs.create(part, False)
        out.write(bytearray(text.encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)

    def _commit(self, version: int, **what) -> None:
        target = self._fs_path(self._file("_commits", version))
        try:
            out = self._fs.create(target, False)
        except Exception as e:
            if self._fs.exists(target):
                raise errors.Conflict(f"version {version} exists") from e
            raise errors.Backend(str(e)) from e
        out.write(bytearray((json.dumps({"version": version} | what) + "\n").encode()))
        out.close()
        while version > 0 and not self._fs.exists(self._fs_path(self._file("feed", version))):
            (c,) = self._lines("_commits", version)
            self._put("feed", version, json.dumps({"version": version, "kind": c.kind, "events": c.events}) + "\n")
            if version % SNAPSHOT == 0:
                self._put("_snapshots", version, "".join(json.dumps({k: v for k, v in vars(c).items() if v is not None}) + "\n" for c in self._commits(version)))
            version -= 1

    def _retried(self, attempt):
        for i in range(TRIES):
            try:
                return attempt(self.version())
            except errors.Conflict:
                if i == TRIES - 1:
                    raise

    def _read(self, paths: list[str], schema: T.StructType) -> DataFrame:
        paths = [f"{self.path}/{p}" for p in paths if p]
        if not paths:
            return self.spark.createDataFrame([], schema)
        read = self.spark.read.schema(schema)
        # events lie in events/append=<name>/topic=<topic>
        return (read.option("basePath", f"{self.path}/events") if "topic" in schema.names and "is_new" in schema.names else read).parquet(*paths).select(schema.names)

    # state

    def _all(self, commits: list) -> DataFrame:
        return self._read([c.events for c in commits], schemas.STORED).where("is_new").select(schemas.EVENT.names)

    def _ids(self, commits: list, where: Column | None = None) -> DataFrame:
        """Ids ever stored: those of events, and those that compaction kept of removed ones; ``where`` is pushed into the scans."""
        cols = [*STREAM, "event_id", "seq"]
        kept = T.StructType([f for f in schemas.EVENT.fields if f.name in cols])
        out = self._all(commits).select(cols).unionByName(self._read([c.ids for c in commits], kept).select(cols))
        return out if where is None else out.where(where)

    def _heads(self, commits: list) -> DataFrame:
        return self._read([c.heads for c in commits], schemas.HEAD).groupBy(*STREAM).agg(F.max("next_seq").alias("next_seq"))

    def _truncations(self, commits: list) -> DataFrame:
        return self._read([c.rows for c in commits if c.kind in ("truncate", "compact")], schemas.TRUNCATION)

    def _checkpoints(self, commits: list) -> DataFrame:
        return self._read([c.rows for c in commits if c.kind == "checkpoint"] + [c.checkpoints for c in commits if c.kind == "compact"], schemas.CHECKPOINT)

    def events(self) -> DataFrame:
        """All visible rows."""
        commits = self._commits(self.version())
        return cursor.visible(self._all(commits), self._truncations(commits))

    def heads(self) -> DataFrame:
        return self._heads(self._commits(self.version()))

    def checkpoints(self) -> DataFrame:
        return cursor.checkpoint_state(self._checkpoints(self._commits(self.version())))

    def appended(self, paths: list[str]) -> DataFrame:
        """The events of some commits, as they were when these were made."""
        return self._read(paths, schemas.STORED).where("is_new").select(schemas.EVENT.names)

    def _sources(self, commits: list) -> dict[str, int]:
        """The last micro-batch of each query, and -1 for each source without a number."""
        out: dict[str, int] = {}
        for source in (s for c in commits for s in [*(c.sources or ()), *([c.source] if c.source else ())]):
            name, i = _split(source)
            out[name] = max(i, out.get(name, -1))
        return out

    # operations

    def append(self, batch: DataFrame, source: str | None = None, told: Callable[[str, int], None] | None = None) -> DataFrame:
        """ordinal and seq of each record, in any order. Ordinals are unique in a batch.

        ``source`` names a micro-batch, as <query>/<number>: if it or a later one is there already, nothing is written again. ``told`` gets the stream
        (* for several) and the number of records."""
        batch = batch.withColumns({"dest_kind": F.lit(self.kind), "dest_logical": F.lit(self.logical)})
        streams = schemas.normal(batch).withColumn("_bad", log.invalid()).groupBy("topic", "key").agg(F.count("*").alias("n"), F.max("_bad").alias("bad"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
        ends = [F.min("topic").alias("lo_topic"), F.max("topic").alias("hi_topic"), F.min("lo").alias("lo_id"), F.max("hi").alias("hi_id")]
        found = streams.agg(F.max("n").alias("largest"), F.sum("n").alias("n"), F.max("bad").alias("bad"), F.count("*").alias("streams"), F.max("key").alias("key"), *ends).first()
        if not found.largest:
            return self.spark.createDataFrame([], "ordinal long, seq long")
        if found.bad:
            raise errors.Validation(log.INVALID)
        mode = log.policy(F.col("topic"), self.default_mode, self.by_topic)
        near = F.col("topic").between(found.lo_topic, found.hi_topic) & F.col("event_id").between(found.lo_id, found.hi_id)

        def attempt(version):
            commits = self._commits(version)
            name = uuid.uuid4().hex
            if source is not None and _split(source)[1] <= self._sources(commits).get(_split(source)[0], -2):
                ids = keyed(self._ids(commits, near)).groupBy(*JOIN, "event_id").agg(F.min("seq").alias("seq"))
                return keyed(schemas.normal(batch)).join(ids, [*JOIN, "event_id"], "left").select("ordinal", "seq")
            planned = log.plan_append(batch, self._ids(commits, near & (mode != "none")), self._heads(commits), mode, buckets=1 + found.largest // HOT_STREAM)
            self._write(planned.select(schemas.STORED.names), f"events/append={name}")
            planned = self._read([f"events/append={name}"], schemas.STORED)
            log.heads(planned.where("is_new")).coalesce(1 + found.largest // HOT_STREAM).write.parquet(f"{self.path}/heads/{name}")
            self._commit(version + 1, kind="append", events=f"events/append={name}", heads=f"heads/{name}", source=source)
            return planned.select("ordinal", "seq")

        out = self._retried(attempt)
        if told:
            told("*" if found.streams > 1 else found.lo_topic if found.key is None else f"{found.lo_topic}/{found.key}", found.n)
        return out

    def _write(self, stored: DataFrame, name: str) -> None:
        dealt = stored.repartition("topic", "key", F.floor(F.col("seq") / STRETCH))
        dealt.sortWithinPartitions("topic", "key", "seq").write.partitionBy("topic").parquet(f"{self.path}/{name}")

    def _stream(self, topic: str, key: str | None) -> Column:
        return log.on_stream(topic, key, self.kind, self.logical)

    def read_from(self, topic: str, key: str | None, after: int, limit: int) -> DataFrame:
        log.check_limit(limit)
        return log.read_from(self.events(), self._stream(topic, key), after, limit)

    def read_from_topic(self, topic: str, key: str | None, after: int, limit: int) -> DataFrame:
        """One key's rows, or, with None, all keys'."""
        if key is not None:
            return self.read_from(topic, key, after, limit)
        log.check_limit(limit)
        return log.read_from_topic(self.events(), (F.col("topic") == topic) & log.on_destination(self.kind, self.logical), after, limit)

    def read_all(self, topic: str, key: str | None, page: int = log.MAX_LIMIT):
        """Pages of a stream until there are no more."""
        after = 0
        while rows := self.read_from(topic, key, after, page).collect():
            yield rows
            after = rows[-1].seq

    def commit_checkpoint(self, subscription: str, topic: str, key: str | None, seq: int) -> None:
        def attempt(version):
            name = f"checkpoints/{uuid.uuid4().hex}"
            self.spark.createDataFrame([(subscription, self.kind, self.logical, topic, key or None, seq)], schemas.CHECKPOINT).write.parquet(f"{self.path}/{name}")
            self._commit(version + 1, kind="checkpoint", rows=name)

        self._retried(attempt)

    def load_checkpoint(self, subscription: str, topic: str, key: str | None) -> int | None:
        row = cursor.load_checkpoint(self.checkpoints(), subscription).where(self._stream(topic, key)).first()
        return None if row is None else row.seq

    def truncate_before(self, topic: str, key: str | None, bound: int) -> int:
        """Removes the stream's rows below the bound; how many that were."""

        def attempt(version):
            commits = self._commits(version)
            head = self._heads(commits).where(self._stream(topic, key)).first()
            row = self.spark.createDataFrame([(self.kind, self.logical, topic, key or None, bound, head.next_seq if head else 0, version + 1)], schemas.TRUNCATION)
            n = cursor.removed(self._all(commits).where(self._stream(topic, key)), self._truncations(commits), row.select(*STREAM, "bound")).first().removed
            name = f"truncations/{uuid.uuid4().hex}"
            row.write.parquet(f"{self.path}/{name}")
            self._commit(version + 1, kind="truncate", rows=name)
            return n

        return self._retried(attempt)

    def compact(self) -> None:
        """Rewrites the state as one commit: visible rows by stream, heads, the ids of removed rows, checkpoints, truncations in force and the last micro-batch of each query. Old files stay for readers."""

        def attempt(version):
            commits = self._commits(version)
            name = uuid.uuid4().hex
            all_, gone = self._all(commits), self._truncations(commits)
            live = cursor.visible(all_, gone)
            stored = live.withColumns({"ordinal": F.lit(None).cast("long"), "is_new": F.lit(True)}).select(schemas.STORED.names)
            self._write(stored, f"events/append={name}")
            cols = [*JOIN, "event_id"]
            lost = keyed(self._ids(commits)).join(keyed(live).select(cols), cols, "left_anti").select(*STREAM, "event_id", "seq")
            lost.write.parquet(f"{self.path}/ids/{name}")
            self._heads(commits).write.parquet(f"{self.path}/heads/{name}")
            cursor.checkpoint_state(self._checkpoints(commits)).write.parquet(f"{self.path}/checkpoints/{name}")
            cursor.floors(gone).withColumn("version", F.lit(version).cast("long")).write.parquet(f"{self.path}/truncations/{name}")
            self._commit(version + 1, kind="compact", events=f"events/append={name}", heads=f"heads/{name}", ids=f"ids/{name}", rows=f"truncations/{name}", checkpoints=f"checkpoints/{name}", sources=[f"{n}/{i}" if i >= 0 else n for n, i in self._sources(commits).items()], replaces=version)

        self._retried(attempt)
