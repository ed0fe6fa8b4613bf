"""Incremental evaluation: the same results as the full one, kept up to date as versions arrive, however late.

``winner_changes`` deduplicates a stream of versions into the signed change feed. ``LinearView`` keeps a sum by aggregating deltas alone.
``FoldView`` keeps an ordered fold: a batch replays its groups from their earliest change on and emits what differs.
There is no watermark: late events rewrite history, so state grows with the log; state stores are RocksDB or Parquet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.operators import stategraph

SHARDS = 64
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def winner_changes(versions: DataFrame, identity: Sequence[str], version: Sequence[str], payload: Sequence[str] = ()) -> DataFrame:
    """The signed feed of a stream of versions: identity, version, payload and ``weight``.

    A key's state is its least version so far; a lesser one retracts it. The session must use the RocksDB state store.
    """
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    fields = {f.name: f for f in versions.schema}
    kept = T.StructType([fields[c] for c in (*version, *payload)])
    out = T.StructType([*[fields[c] for c in (*identity, *version, *payload)], T.StructField("weight", T.IntegerType())])
    columns, n = [*version, *payload], len(version)

    class Least(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.least = handle.getValueState("least", kept)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            old = self.least.get() if self.least.exists() else None
            best = old
            for pdf in rows:
                for row in pdf[columns].itertuples(index=False, name=None):
                    if best is None or tuple(row[:n]) < tuple(best[:n]):
                        best = row
            if best is not old:
                self.least.update(tuple(best))
                signed = [(*key, *best, 1)] if old is None else [(*key, *old, -1), (*key, *best, 1)]
                yield pd.DataFrame(signed, columns=[*identity, *columns, "weight"])

        def close(self) -> None:
            pass

    return versions.select(*identity, *columns).groupBy(*identity).transformWithStateInPandas(statefulProcessor=Least(), outputStructType=out, outputMode="Append", timeMode="None")


class _View:
    """A result in a folder that all executors share, a version for each epoch; running an epoch again gives the same."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _epochs(self, name: str) -> list[int]:
        base = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        fs = base.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            return []
        done = [s.getPath() for s in fs.listStatus(base)]
        return sorted(int(p.getName().split("=")[1]) for p in done if "=" in p.getName() and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def _read(self, name: str, epoch: int, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}/epoch={epoch}")

    def _write(self, df: DataFrame, name: str, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/epoch={epoch}")


class LinearView(_View):
    """A sum by keys over a signed feed; use ``apply`` as a foreachBatch function over ``winner_changes``."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], value: str, total: str):
        super().__init__(spark, path)
        self.keys, self.value, self.total = list(keys), value, total

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """An epoch costs as much as its batch: only the delta is aggregated and written."""
        self._write(batch.groupBy(*self.keys).agg(F.sum(F.col(self.value) * F.col("weight")).alias(self.total)), "deltas", epoch)

    def current(self) -> DataFrame | None:
        done = self._epochs("deltas")
        if not done:
            return None
        deltas = self.spark.read.parquet(*[f"{self.path}/deltas/epoch={e}" for e in done])
        return deltas.groupBy(*self.keys).agg(F.sum(self.total).alias(self.total))


class FoldView(_View):
    """An ordered fold's timeline over a signed feed, and the retractions and assertions of each epoch."""

    def __init__(self, spark: SparkSession, path: str, handler: stategraph.Handler, group: Sequence[str], order: Sequence[str], key_type: str = "string", value_type: str = "string"):
        super().__init__(spark, path)
        self.handler, self.group, self.order, self.key_type, self.value_type = handler, list(group), list(order), key_type, value_type

    def _sharded(self, df: DataFrame) -> DataFrame:
        return df.withColumn("shard", F.pmod(F.xxhash64(*self.group), F.lit(SHARDS)).cast("int"))

    def _put(self, df: DataFrame, name: str, epoch: int) -> None:
        self._sharded(df).hint("rebalance", "shard").write.mode("overwrite").partitionBy("shard").parquet(f"{self.path}/{name}/epoch={epoch}")

    def _get(self, name: str, epochs: Sequence[int], schema: T.StructType, shards: Sequence[int] | None = None) -> DataFrame:
        """What epochs wrote, with ``epoch``; other shards aren't read."""
        if not epochs:
            return self.spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("epoch", T.LongType())]))
        full = T.StructType([*schema.fields, T.StructField("epoch", T.LongType()), T.StructField("shard", T.IntegerType())])
        out = self.spark.read.schema(full).option("basePath", f"{self.path}/{name}").parquet(*[f"{self.path}/{name}/epoch={e}" for e in epochs])
        return (out if shards is None else out.where(F.col("shard").isin(list(shards)))).drop("shard")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        """``batch`` has the events' columns and ``weight``; a retracted event leaves the log and its group is replayed from there. Of the log and of the
        timeline only the shards of the batch's groups are read."""
        self._put(batch, "feed", epoch)
        feed_of = lambda epochs, shards=None: self._get("feed", epochs, batch.schema, shards).drop("epoch")
        new = feed_of([epoch])
        shards = sorted(r.shard for r in self._sharded(new).select("shard").distinct().collect())  # SHARDS at most
        feed = feed_of([e for e in self._epochs("feed") if e <= epoch], shards)
        columns = [c for c in batch.columns if c != "weight"]
        since = new.groupBy(*self.group).agg(F.min(F.struct(*self.order)).alias("since_ord"))
        groups = since.select(*self.group)
        events = feed.join(groups, self.group, "left_semi").groupBy(*columns).agg(F.sum("weight").alias("weight")).where("weight > 0").drop("weight")
        shape = stategraph._shape(events, self.group, self.order, self.key_type, self.value_type)
        self._shape = shape
        before = self._latest([e for e in self._epochs("timeline") if e < epoch], shape, shards).join(groups, self.group, "left_semi")
        after = stategraph.replay(events, before, since, self.handler, self.group, self.order, self.key_type, self.value_type)
        self._put(groups, "groups", epoch)
        self._put(after, "timeline", epoch)
        now = self._get("timeline", [epoch], shape).drop("epoch")
        keyed = lambda df: df.select(*self.group, "key", F.struct(*self.order).alias("ord"), "value")
        self._write(stategraph.effective_changes(keyed(before), keyed(now), [*self.group, "key"]), "changes", epoch)

    def _latest(self, epochs: list[int], shape: T.StructType, shards: Sequence[int] | None = None) -> DataFrame:
        """Each group's timeline of the last epoch that touched it: an epoch writes the groups of its batch and no others."""
        named = T.StructType([f for f in shape if f.name in self.group])
        last = self._get("groups", epochs, named, shards).groupBy(*self.group).agg(F.max("epoch").alias("epoch"))
        return self._get("timeline", epochs, shape, shards).join(last, [*self.group, "epoch"], "left_semi").drop("epoch")

    def _shape_there(self) -> T.StructType | None:
        done = self._epochs("timeline")
        if not hasattr(self, "_shape") and done:
            seen = self.spark.read.parquet(f"{self.path}/timeline/epoch={done[-1]}").schema
            self._shape = T.StructType([f for f in seen if f.name != "shard"])
        return getattr(self, "_shape", None) if done else None

    def timeline(self) -> DataFrame | None:
        shape = self._shape_there()
        return None if shape is None else self._latest(self._epochs("timeline"), shape)

    def compact(self) -> None:
        """One epoch in place of all there are: the events that are left, and each group's present timeline. None of them can be run again then."""
        done, shape = self._epochs("timeline"), self._shape_there()
        if len(done) < 2:
            return
        top = done[-1]
        seen = self.spark.read.parquet(f"{self.path}/feed/epoch={top}").schema
        schema = T.StructType([f for f in seen if f.name != "shard"])
        columns = [f.name for f in schema if f.name != "weight"]
        left = self._get("feed", self._epochs("feed"), schema).groupBy(*columns).agg(F.sum("weight").cast(schema["weight"].dataType).alias("weight")).where("weight <> 0").select(*[f.name for f in schema])
        whole = self._latest(done, shape)
        named = T.StructType([f for f in shape if f.name in self.group])
        groups = self._get("groups", done, named).select(*self.group).distinct()
        for name, df in (("feed", left), ("timeline", whole), ("groups", groups)):
            self._put(df, f"compact/{name}", top)
        fs_of = lambda path: (at := self.spark._jvm.org.apache.hadoop.fs.Path(path), at.getFileSystem(self.spark._jsc.hadoopConfiguration()))
        for name in ("feed", "timeline", "groups"):
            for e in self._epochs(name):
                old, fs = fs_of(f"{self.path}/{name}/epoch={e}")
                fs.delete(old, True)
            (made, fs), (place, _) = fs_of(f"{self.path}/compact/{name}/epoch={top}"), fs_of(f"{self.path}/{name}/epoch={top}")
            fs.rename(made, place)

    def changes(self, epoch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/changes/epoch={epoch}")


def run(stream: DataFrame, view: _View, checkpoint: str):
    """Feed all that a stream has now to a view, and stop."""
    query = stream.writeStream.foreachBatch(view.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
