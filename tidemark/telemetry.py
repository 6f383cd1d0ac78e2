"""Telemetry: a store that tells a sink how long its calls took."""

import os
import time
from dataclasses import dataclass, field
from typing import Protocol


class Sink(Protocol):
    def on_append(self, stream: str, records: int, seconds: float) -> None: ...
    def on_read(self, stream: str, rows: int, seconds: float) -> None: ...
    def on_checkpoint(self, subscription: str, stream: str, seq: int) -> None: ...
    def on_truncate(self, stream: str, bound: int, removed: int) -> None: ...
    def on_error(self, operation: str, error: Exception) -> None: ...


class NoSink:
    def on_append(self, stream, records, seconds):
        pass

    def on_read(self, stream, rows, seconds):
        pass

    def on_checkpoint(self, subscription, stream, seq):
        pass

    def on_truncate(self, stream, bound, removed):
        pass

    def on_error(self, operation, error):
        pass


@dataclass
class ConsoleSink(NoSink):
    """A line of text for each call."""

    write: object = print
    counts: dict = field(default_factory=dict)

    def _say(self, what: str, text: str) -> None:
        self.counts[what] = self.counts.get(what, 0) + 1
        self.write(f"[log] {what} {text}")

    def on_append(self, stream, records, seconds):
        self._say("append", f"stream={stream} records={records} ms={1000 * seconds:.3f}")

    def on_read(self, stream, rows, seconds):
        self._say("read", f"stream={stream} rows={rows} ms={1000 * seconds:.3f}")

    def on_checkpoint(self, subscription, stream, seq):
        self._say("checkpoint", f"subscription={subscription} stream={stream} seq={seq}")

    def on_truncate(self, stream, bound, removed):
        self._say("truncate", f"stream={stream} before={bound} removed={removed}")

    def on_error(self, operation, error):
        self._say("error", f"operation={operation} error={error}")


def sink_from_env(name: str = "TIDEMARK_TELEMETRY") -> Sink:
    """off, 0, false or none: no sink; anything else, or unset: the console."""
    return NoSink() if os.environ.get(name, "").strip().lower() in ("off", "0", "false", "none") else ConsoleSink()


class Instrumented:
    """A store with telemetry, with the store's own results. Appends of no records and loading a checkpoint aren't reported."""

    def __init__(self, store, sink: Sink | None = None) -> None:
        self.store, self.sink = store, sink or sink_from_env()

    def __getattr__(self, name):
        return getattr(self.store, name)

    def _call(self, operation, run):
        start = time.perf_counter()
        try:
            return run(), time.perf_counter() - start
        except Exception as e:
            self.sink.on_error(operation, e)
            raise

    @staticmethod
    def _name(topic, key):
        return topic if not key else f"{topic}/{key}"

    def append(self, batch, source=None):
        what = []
        out, s = self._call("append", lambda: self.store.append(batch, source, lambda *x: what.extend(x)))
        if what:
            self.sink.on_append(*what, s)
        return out

    def _read(self, operation, name, run):
        """The rows, which a read's limit bounds, are taken within the timing and come back as a DataFrame."""
        (schema, rows), s = self._call(operation, lambda: ((df := run()).schema, df.collect()))
        self.sink.on_read(name, len(rows), s)
        return self.store.spark.createDataFrame(rows, schema)

    def read_from(self, topic, key, after, limit):
        return self._read("read_from", self._name(topic, key), lambda: self.store.read_from(topic, key, after, limit))

    def read_from_topic(self, topic, key, after, limit):
        return self._read("read_from_topic", topic, lambda: self.store.read_from_topic(topic, key, after, limit))

    def commit_checkpoint(self, subscription, topic, key, seq):
        self._call("commit_checkpoint", lambda: self.store.commit_checkpoint(subscription, topic, key, seq))
        self.sink.on_checkpoint(subscription, self._name(topic, key), seq)

    def truncate_before(self, topic, key, bound):
        out, _ = self._call("truncate_before", lambda: self.store.truncate_before(topic, key, bound))
        self.sink.on_truncate(self._name(topic, key), bound, out)
        return out
