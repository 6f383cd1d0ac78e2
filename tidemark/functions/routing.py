"""Where a topic or key belongs: constant, longest prefix, or hash; and the registry of destinations."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark import errors


def constant(destination: str) -> Column:
    return F.lit(destination)


def longest_prefix(topic: Column, rules: list[tuple[str, str]], fallback: str | None = None) -> Column:
    """The destination of the longest prefix; of equal ones the first registered."""
    out = F.lit(fallback)
    for _, _, prefix, destination in sorted((len(p), -i, p, d) for i, (p, d) in enumerate(rules)):
        out = F.when(topic.startswith(prefix), destination).otherwise(out)
    return out


def by_hash(key: Column, destinations: list[str]) -> Column:
    """The key's destination by a stable hash (15 hex digits of md5); the first one for no key."""
    if not destinations:
        raise errors.Internal("no destinations to spread over")
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % len(destinations)
    place = F.when(key.isNull(), 0).otherwise(number).cast("int")
    return F.get(F.array(*(F.lit(d) for d in destinations)), place)


def cell(key: Column, n: int) -> Column:
    number = F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % n
    return F.when(key.isNull(), 0).otherwise(number).cast("long")


class Registry:
    """Backends by router key; registering again replaces."""

    _shared: "Registry | None" = None

    def __init__(self) -> None:
        self._backends: dict[str, object] = {}

    def register(self, router_key: str, backend: object) -> "Registry":
        self._backends[router_key] = backend
        return self

    def resolve(self, router_key: str) -> object:
        try:
            return self._backends[router_key]
        except KeyError:
            raise errors.Internal(f"no backend for {router_key}") from None

    def resolve_stream(self, evaluate, topic: str, key: str | None = None) -> object:
        return self.resolve(evaluate(topic, key))

    @classmethod
    def set_global(cls, registry: "Registry") -> None:
        """The first one stays."""
        cls._shared = cls._shared or registry

    @classmethod
    def get_global(cls) -> "Registry | None":
        return cls._shared


def unknown(routed: DataFrame, registered: DataFrame, column: str) -> DataFrame:
    """Rows whose destination isn't registered."""
    return routed.join(registered, column, "left_anti")
