"""Event types, the columns of the log, and what can be wrong with input."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

USER = "struct<id:bigint,server:binary>"
ORD = "struct<ts:bigint,route_id:bigint,tx_id:bigint,sender:string>"
ANCHOR = "struct<tx_id:bigint,route_id:bigint,idx:int,sender:string>"
TEXT_UPDATE = f"struct<new_anchors:array<struct<parent:{ANCHOR},offset:int>>,new_strings:array<string>,deletions:array<{ANCHOR}>>"
RAW = "sender string, tx_id bigint, msg_type string, `group` string, body string, ts bigint, node int, arrival_seq bigint"
IDENTITY = ("sender", "route_id", "tx_id")


class LogError(Exception):
    """Anything that the engine refuses."""


class RejectedBatch(LogError):
    """A batch that fails validation; none of it is stored."""


class UnknownUser(RejectedBatch):
    """A sender or a body names a user that isn't registered."""


class UnknownSender(RejectedBatch):
    """An event comes from a sender that isn't registered."""


class UnknownData(RejectedBatch):
    """A data reference has no object."""


class UnknownEvent(RejectedBatch):
    """An event id has no event."""


class ForwardReference(RejectedBatch):
    """A data object refers to itself or to a later one."""


class ContentMismatch(RejectedBatch):
    """A data object's content doesn't have the hash in its id."""


class GearError(LogError):
    """A rule that is unknown, defined twice, part of a cycle, or that fails."""


class RoutingError(LogError):
    """A value that has no canonical form, such as a function."""


class EvaluationError(LogError):
    """An expression applied to what it isn't defined for."""


@dataclass(frozen=True)
class EventType:
    name: str
    group: T.DataType
    body: T.DataType


class Records:
    """Record shapes by name, in the order in which they are registered."""

    def __init__(self) -> None:
        self._shapes: dict[str, T.StructType] = {}

    def register(self, name: str, fields: str) -> T.StructType:
        """A shape, given as DDL; the same shape again under its name is the same."""
        shape = T.StructType.fromDDL(fields)
        if self._shapes.setdefault(name, shape) != shape:
            raise LogError(f"record {name} is registered with other fields")
        return shape

    def exact(self, *names: str) -> str | None:
        """The first record that has just these fields, in this order."""
        return next((n for n, s in self._shapes.items() if s.names == list(names)), None)

    def of(self, *names: str) -> str:
        """The first record that has all these fields, and perhaps more."""
        for name, shape in self._shapes.items():
            if set(names) <= set(shape.names):
                return name
        raise EvaluationError(f"no record has the fields {', '.join(names)}")

    def make(self, **fields: Column) -> Column:
        """A value of the first record that has all the fields; what isn't given is null."""
        shape = self._shapes[self.of(*fields)]
        return F.struct(*[fields.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in shape])

    def __getitem__(self, name: str) -> T.StructType:
        try:
            return self._shapes[name]
        except KeyError:
            raise LogError(f"no record {name}") from None


class EventTypes:
    """Event types by name, declared before the log opens and frozen from then on."""

    def __init__(self) -> None:
        self._types: dict[str, EventType] = {}
        self._frozen = False

    def register(self, name: str, group: str, body: str) -> EventType:
        if self._frozen:
            raise LogError(f"event type {name} is declared after the log opened")
        if name in self._types:
            raise LogError(f"event type {name} is declared twice")
        made = EventType(name, T.DataType.fromDDL(group), T.DataType.fromDDL(body))
        self._types[name] = made
        return made

    def freeze(self) -> None:
        self._frozen = True

    def __getitem__(self, name: str) -> EventType:
        try:
            return self._types[name]
        except KeyError:
            raise LogError(f"no event type {name}") from None

    def __iter__(self):
        return iter(self._types.values())
