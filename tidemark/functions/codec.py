"""Storage keys as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Key prefixes by kind, and the separators.
PREFIXES = {"surreal_local": "surreal", "memory": "memory", "postgres": "postgres", "sqlite": "sqlite", "scylla": "scylla", "tikv_raw": "tikv"}
UNIT, NUL = "\x1f", "\x00"


def prefix(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, p in PREFIXES.items():
        out = F.when(kind == name, p).otherwise(out)
    return out


def router_key(kind: Column, logical: Column) -> Column:
    return F.concat(prefix(kind), F.lit(":"), logical)


def partition_key(topic: Column, key: Column) -> Column:
    return F.concat(topic, F.lit(UNIT), F.coalesce(key, F.lit("")))


def storage_key(kind: Column, logical: Column, topic: Column, key: Column) -> Column:
    """prefix:logical, topic and key (empty for none) with a unit separator between. Null where a part holds the separator: such keys would collide."""
    safe = ~(F.contains(logical, F.lit(UNIT)) | F.contains(topic, F.lit(UNIT)) | F.contains(F.coalesce(key, F.lit("")), F.lit(UNIT)))
    return F.when(safe, F.concat(router_key(kind, logical), F.lit(UNIT), partition_key(topic, key)))


def key_of(storage: Column) -> Column:
    """The stream's key in a storage key, null for none."""
    key = F.substring_index(storage, UNIT, -1)
    return F.when(key != "", key)


def checkpoint_key(subscription: Column, storage: Column) -> Column:
    return F.concat(subscription, F.lit(NUL), storage)


def event_key(storage: Column, seq: Column) -> Column:
    """Zero-padded, so that bytes sort as numbers."""
    return F.concat(F.lit("s/"), storage, F.lit("/e/"), F.lpad(seq.cast("string"), 20, "0"))


def seq_of(event: Column) -> Column:
    return F.substring_index(event, "/", -1).cast("long")


def write_consistency(name: Column) -> Column:
    """Names of write consistency levels; null for unknown ones."""
    out = F.lit(None).cast("string")
    for k, v in {"one": "ONE", "local_one": "LOCAL_ONE", "quorum": "LOCAL_QUORUM", "local_quorum": "LOCAL_QUORUM"}.items():
        out = F.when(F.lower(name) == k, v).otherwise(out)
    return out
