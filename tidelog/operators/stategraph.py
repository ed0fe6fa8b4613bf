"""Ordered keyed folds: handlers read and write keyed state as of their own position in event order.

A handler that reads only other rules' timelines is an as-of join (``depend``). One that reads what it also writes is sequential within its
group and runs in Python (``fold``): rows are sorted by group and position within partitions and streamed past the handler, so a task holds the
current values of one group and never its events. Groups run in parallel, and a replay after late events starts at the earliest change.
Results depend on the set of events alone, not on how or in which order they arrived.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import timeline

Handler = Callable[["Context", dict], None]
BATCH = 10_000


class Context:
    """What a handler sees: its group's state strictly before the event, and dependencies up to and including it."""

    def __init__(self, state: dict | None = None):
        self._state = {} if state is None else state
        self._dependencies: dict = {}
        self._writes: dict = {}

    def query(self, key):
        """The value that earlier events left at ``key``, or None; the event's own writes don't show."""
        return self._state.get(key)

    def update(self, key, value) -> None:
        """Write a value at the event's position; the last write to a key in an event counts."""
        self._writes[key] = value

    def dep_query(self, name: str, key):
        """The latest value of another rule's timeline at or before the event, or None."""
        return self._dependencies.get((name, key))

    def _run(self, handler: Handler, event: dict) -> dict:
        self._writes = {}
        handler(self, event)
        self._state.update(self._writes)
        return self._writes


def run_events(events: Sequence[dict], handler: Handler) -> list[tuple[dict, dict]]:
    """(event, its writes) of one group's events, which are in order."""
    context = Context()
    return [(e, context._run(handler, e)) for e in events]


def _shape(events: DataFrame, group: Sequence[str], order: Sequence[str], key_type: str, value_type: str) -> T.StructType:
    fields = {f.name: f.dataType for f in events.schema}
    kind = T.StructType.fromDDL(f"key {key_type}, value {value_type}")
    named = [(c, fields[c]) for c in group] + [("key", kind["key"].dataType)] + [(c, fields[c]) for c in order] + [("value", kind["value"].dataType)]
    return T.StructType([T.StructField(c, t) for c, t in named])


def _streamed(events: DataFrame, start: DataFrame | None, dependencies: DataFrame | None, handler: Handler, group: Sequence[str], order: Sequence[str], shape: T.StructType) -> DataFrame:
    """The writes of ``handler``; ``start`` (as the result) is what was written before, and dependencies at a position come before its events."""
    at = [F.col(c).alias(f"__o{k}") for k, c in enumerate(order)]
    own = [F.col(c).alias(f"__g{k}") for k, c in enumerate(group)]
    empty = {"__e": events.select(F.struct(*events.columns).alias("e")).schema["e"].dataType, "__k": shape["key"].dataType, "__v": shape["value"].dataType}
    if dependencies is not None:
        empty |= {"__n": dependencies.schema["dep"].dataType, "__dk": dependencies.schema["dep_key"].dataType, "__dv": dependencies.schema["dep_value"].dataType}

    def side(df: DataFrame, number: int, **has) -> DataFrame:
        return df.select(*own, *at, F.lit(number).alias("__s"), *[has.get(c, F.lit(None)).cast(t).alias(c) if c not in has else has[c].alias(c) for c, t in empty.items()])

    rows = side(events, 2, __e=F.struct(*events.columns))
    if start is not None:
        rows = rows.unionByName(side(start, 0, __k=F.col("key"), __v=F.col("value")))
    if dependencies is not None:
        rows = rows.unionByName(side(dependencies, 1, __n=F.col("dep"), __dk=F.col("dep_key"), __dv=F.col("dep_value")))
    groups, orders = [f"__g{k}" for k in range(len(group))], [f"__o{k}" for k in range(len(order))]
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, context, out = None, Context(), []
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for batch in batches:
            for r in batch.to_pylist():
                name = tuple(r[c] for c in groups)
                if name != here:
                    here, context = name, Context()
                if r["__s"] == 2:
                    place = tuple(r[c] for c in orders)
                    for key, value in context._run(handler, r["__e"]).items():
                        out.append((*name, key, *place, value))
                    if len(out) >= BATCH:
                        yield give()
                        out = []
                elif r["__s"] == 0:
                    context._state[r["__k"]] = r["__v"]
                else:
                    context._dependencies[r["__n"], r["__dk"]] = r["__dv"]
        if out:
            yield give()

    return rows.repartition(*groups).sortWithinPartitions(*groups, *orders, "__s").mapInArrow(run, shape)


def fold(events: DataFrame, handler: Handler, group: Sequence[str], order: Sequence[str], key_type: str = "string", value_type: str = "string", dependencies: DataFrame | None = None) -> DataFrame:
    """The timeline (group, key, order columns, value) that ``handler`` writes over each group's events in order.

    ``dependencies`` has the group columns, ``dep`` (a name), ``dep_key``, ``dep_value`` and the order columns. One shuffle by group. An error in
    a handler fails the query. A handler gets an event's columns by name, nulls as None.
    """
    return _streamed(events, None, dependencies, handler, group, order, _shape(events, group, order, key_type, value_type))


def replay(events: DataFrame, before: DataFrame, since: DataFrame, handler: Handler, group: Sequence[str], order: Sequence[str], key_type: str = "string", value_type: str = "string") -> DataFrame:
    """The timeline after late events: each group of ``since`` (group, and ``since_ord``, its earliest change) is folded again from there on,
    starting from the state that ``before`` had; other groups and earlier positions stay as they are."""
    ord_of, shape = F.struct(*order), _shape(events, group, order, key_type, value_type)
    columns = [f.name for f in shape]
    touched = events.join(since, list(group)).where(ord_of >= F.col("since_ord")).select(*events.columns)
    early = before.join(since, list(group), "left").where(F.col("since_ord").isNull() | (ord_of < F.col("since_ord"))).select(*columns)
    # only each key's last value before the change is state
    kept = early.join(since.select(*group), list(group), "left_semi")
    last = kept.groupBy(*group, "key").agg(F.max(ord_of).alias("o"), F.max_by("value", ord_of).alias("v"))
    start = last.select(*group, "key", *[F.col(f"o.{c}").alias(c) for c in order], F.col("v").alias("value"))
    return early.unionByName(_streamed(touched, start, None, handler, group, order, shape))


def depend(events: DataFrame, dependency: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value", into: str = "dep") -> DataFrame:
    """Each event with the dependency's value at its position (inclusive): a handler that reads only other rules' output."""
    return timeline.latest_at(events, dependency, key, ord_col, value, into)


def affected_readers(reads: DataFrame, writes: DataFrame, changed: DataFrame, key: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """The reads whose value a change can alter: positions after a changed write up to and including the key's next write.

    Those are the reads whose latest earlier write is a changed one, so each read looks up one write, however many there are.
    """
    marked = changed.select(*key, ord_col).distinct().withColumn("__changed", F.lit(True))
    known = writes.select(*key, ord_col).distinct().join(marked, [*key, ord_col], "left").withColumn("__changed", F.coalesce("__changed", F.lit(False)))
    found = timeline.latest_before(reads.select(*reads.columns), known, key, ord_col, "__changed", "__hit")
    return found.where("__hit").select(*reads.columns).distinct()


def read_sets(reads: DataFrame, writes: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """Each read with the position of the write that it saw (``read_ord``, inclusive), null where there was none: what a later change is held against."""
    return timeline.latest_at(reads, writes, key, ord_col, value, "read").drop("read")


def changed_dependencies(old: DataFrame, new: DataFrame, readers: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """The readers of keys whose dependency timeline differs at or before their position."""
    first = timeline.diff(old, new, key, ord_col, value).groupBy(*key).agg(F.min(ord_col).alias("__first"))
    return readers.join(first, list(key)).where(F.col(ord_col) >= F.col("__first")).drop("__first")


def effective_changes(before: DataFrame, after: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """Rows to retract and assert between two evaluations; equal values give none, so nothing follows from them."""
    return timeline.diff(before, after, key, ord_col, value)
