"""The append-only event log.

An event's identity is (sender, route, tx_id). Of several versions the smallest (ts, node) wins, whatever the order of arrival; a version that
arrives earlier in that order than the winner so far retracts it. The winner set and the signed feed are views over what was appended.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tidelog.operators.routing import content_hash, route_id
from tidelog.schema import IDENTITY, RAW, ContentMismatch, ForwardReference, LogError, UnknownData, UnknownEvent, UnknownSender, UnknownUser


def winners(versions: DataFrame, identity: Sequence[str], version: Sequence[str]) -> DataFrame:
    """One row per identity: the version that is least. Partial aggregation keeps one row per identity and task before the shuffle."""
    best = F.min_by(F.struct(*versions.columns), F.struct(*version))
    return versions.groupBy(*[F.col(c).alias(f"__{c}") for c in identity]).agg(best.alias("__w")).select("__w.*")


def change_feed(versions: DataFrame, identity: Sequence[str], version: Sequence[str], arrival: str) -> DataFrame:
    """The signed feed, with ``weight`` +1 or -1 and ``change_seq``: a new least version is added, and the one it replaces is removed."""
    # of versions that arrive at once the least comes first, so the others change nothing
    inorder = Window.partitionBy(*identity).orderBy(arrival, *version)
    row = F.struct(*versions.columns)
    seen = versions.withColumn("__least", F.min(F.struct(*version)).over(inorder.rowsBetween(Window.unboundedPreceding, -1)))
    # each new least replaces the one before it; the same sort serves both windows
    new = seen.where(F.col("__least").isNull() | (F.struct(*version) < F.col("__least"))).withColumn("__old", F.lag(row).over(inorder))
    signed = new.select(
        F.col(arrival).alias("__at"),
        F.explode(F.array(F.struct(row.alias("r"), F.lit(1).alias("w")), F.struct(F.col("__old").alias("r"), F.lit(-1).alias("w")))).alias("__c"),
    ).where("__c.r is not null")
    return signed.select("__c.r.*", F.col("__c.w").alias("weight"), (F.col("__at") * 2 + F.when(F.col("__c.w") > 0, 1).otherwise(0)).alias("change_seq"))


def delta_since(feed: DataFrame, cursor: Column, version_key: Sequence[str]) -> DataFrame:
    """The net change after a cursor: versions added and removed in the same stretch cancel out. A cursor before all gives the winners."""
    late = feed.where(F.col("change_seq") > cursor)
    return late.groupBy(*version_key).agg(F.sum("weight").cast("int").alias("weight")).where("weight <> 0")


def with_order(versions: DataFrame) -> DataFrame:
    """Adds route_id and the total event order ``ord`` to rows of the raw log."""
    routed = versions.withColumn("route_id", route_id(F.col("group")))
    return routed.withColumn("ord", F.struct("ts", "route_id", "tx_id", "sender"))


def scan_group(log: DataFrame, msg_type: str, group: str | None = None) -> DataFrame:
    """The primary input of a rule: an event type, of one group or of all; both filters reach the scan."""
    out = log.where(F.col("msg_type") == msg_type)
    return out if group is None else out.where(F.col("group") == group)


def project_event(log: DataFrame) -> DataFrame:
    """{sender, body} of each event."""
    return log.select("*", F.struct("sender", "body").alias("event"))


def resolve_event(ids: DataFrame, log: DataFrame, id_col: str, event_col: str) -> DataFrame:
    """{sender, body} of the event behind every id; an id without an event is an error when the result is computed."""
    known = project_event(log).select(F.col(event_col).alias("__event"), "event")
    return resolve(ids, known, F.col(id_col) == F.col("__event"), required=UnknownEvent).drop("__event")


def replicate(*nodes: DataFrame) -> DataFrame:
    """The union of nodes' logs; deduplication over it is what every node converges to."""
    out = nodes[0]
    for other in nodes[1:]:
        out = out.unionByName(other, allowMissingColumns=True)
    return out


def first_binding(bindings: DataFrame, key: str, value: str, arrival: str) -> DataFrame:
    """The first value that each key was bound to; later ones are ignored."""
    return bindings.groupBy(key).agg(F.min_by(value, arrival).alias(value))


def data_objects(objects: DataFrame) -> DataFrame:
    """Content-addressed objects, each once; raises where an id's hash isn't its content's. Columns: ts, hash, content."""
    wrong = objects.where(F.col("hash") != content_hash(F.col("content"))).limit(1).count()
    if wrong:
        raise ContentMismatch("a data object's content doesn't have the hash in its id")
    return objects.dropDuplicates(["ts", "hash"])


def resolve(rows: DataFrame, table: DataFrame, on: Column, required: type[Exception] | None = None) -> DataFrame:
    """Look up a dimension; with ``required`` a row without a match is an error of that kind when the result is computed."""
    if required is None:
        return rows.join(table, on, "left")
    marked = table.withColumn("__there", F.lit(True))
    joined = rows.join(marked, on, "left")
    checked = F.assert_true(F.col("__there").isNotNull(), F.lit(f"{required.__name__}: {required.__doc__}"))
    return joined.where(checked.isNull()).drop("__there")


def unresolved(rows: DataFrame, column: str, table: DataFrame, key: str) -> DataFrame:
    """Rows whose reference has no target; a null reference isn't one."""
    target = table.select(F.col(key).alias("__key")).distinct()
    return rows.where(F.col(column).isNotNull()).join(target, F.col(column) == F.col("__key"), "left_anti")


def forward_references(data: DataFrame) -> DataFrame:
    """(position, ref) of the references of data objects to themselves or to later ones; ``data`` has position and refs, an array of positions."""
    return data.select("position", F.explode("refs").alias("ref")).where("ref >= position")


def validate(events: DataFrame, senders: DataFrame, users: DataFrame, data: DataFrame | None = None, user_refs: str | None = None, data_refs: str | None = None) -> None:
    """Refuse a whole batch if a sender, a sender's user, or a user or data reference in a body is unknown.

    ``senders`` has sender and user, ``users`` has user, ``data`` has ts, hash, position and refs (positions that it refers to);
    ``user_refs`` and ``data_refs`` name array columns of the events.
    """
    any_of = lambda df: bool(df.limit(1).count())
    if any_of(unresolved(senders, "user", users, "user")):
        raise UnknownUser(UnknownUser.__doc__)
    if any_of(unresolved(events, "sender", senders, "sender")):
        raise UnknownSender(UnknownSender.__doc__)
    if user_refs and any_of(unresolved(events.select(F.explode(user_refs).alias("ref")), "ref", users, "user")):
        raise UnknownUser(UnknownUser.__doc__)
    if data is not None:
        if any_of(forward_references(data)):
            raise ForwardReference(ForwardReference.__doc__)
        if data_refs and any_of(unresolved(events.select(F.explode(data_refs).alias("ref")), "ref", data, "hash")):
            raise UnknownData(UnknownData.__doc__)


SHARDS = 64


class EventLog:
    """A node's log in Parquet: versions as they arrived, and the signed feed of their winners.

    Both are partitioned by event type and by a shard of the group's route, so readers of a group prune to its shard and filter within it.
    ``arrival_seq`` numbers arrivals at this node, also of what other nodes sent; the number in a batch says the order within it. A batch is appended
    under numbers that no other has, and then its changes of the winner set go to the feed; a feed that was left behind by a failure catches up
    with the next batch. One writer at a time.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def post(self, events: DataFrame, ts: int, senders: DataFrame, users: DataFrame, declared: Sequence[str] = (), **checks) -> None:
        """Validate a batch as a whole, then append it under one timestamp. Columns: sender, tx_id, msg_type, group, body, node, arrival_seq. If types are
        ``declared``, those of all events must be."""
        refs = {k: v for k, v in checks.items() if k in ("user_refs", "data_refs") and v}
        own = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self._schema() if f.name != "ts"]
        with self.staged(events.select(*own, *[F.col(v).alias(f"__{k}") for k, v in refs.items()])) as batch:
            if declared and batch.where(~F.col("msg_type").isin(*declared)).limit(1).count():
                raise LogError("an event of a type that isn't declared")
            validate(batch, senders, users, **checks | {k: f"__{k}" for k in refs})
            self.append(batch.withColumn("ts", F.lit(ts).cast("bigint")))

    @contextmanager
    def staged(self, rows: DataFrame) -> Iterator[DataFrame]:
        """``rows`` as a table beside the log, while a batch is checked and taken in: computed once, and the same for every reader."""
        path = f"{self.path}/staged/{uuid.uuid4().hex}"
        try:
            rows.write.parquet(path)
            yield self.spark.read.schema(rows.schema).parquet(path)
        finally:
            at, fs = self._fs(path)
            fs.delete(at, True)

    def append(self, events: DataFrame, routed: bool = False) -> None:
        """``routed`` events come from another log, with the route_id that it keeps."""
        shaped = events.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self._schema()], _route(routed).alias("route_id"))
        low, high, rows = shaped.agg(F.min("arrival_seq"), F.max("arrival_seq"), F.count("*")).first()
        if not rows:
            return
        base = self._mark("reserved") + 1
        self._set_mark("reserved", base + (0 if low is None else high - low))
        numbered = shaped.withColumn("arrival_seq", F.coalesce(F.col("arrival_seq") - F.lit(low), F.lit(0)) + F.lit(base)).withColumn("shard", placed(F.col("route_id")))
        # balanced by size, so a hot type is many files and a rare one is not
        numbered.hint("rebalance", "msg_type", "shard").write.mode("append").partitionBy("msg_type", "shard").parquet(f"{self.path}/versions")
        self._follow()

    def _follow(self) -> None:
        """Bring the feed up to the versions that are there."""
        done, there = self._mark("fed"), self._mark("reserved")
        there_now = self._versions().where(F.col("arrival_seq") > done)
        places = there_now.select("msg_type", "shard").distinct().collect()  # types x shards at most
        if places:
            columns = [f.name for f in self._schema()]
            new = there_now.select(*columns, _route(True).alias("route_id"))
            old = self._changes([r.msg_type for r in places], [r.shard for r in places]).where("weight > 0")
            touched = new.select(*[F.col(c).alias(f"__{c}") for c in IDENTITY])
            same = F.lit(True)
            for c in IDENTITY:
                same = same & (F.col(c) == F.col(f"__{c}"))
            # the latest addition to an identity is its winner so far
            known = old.join(touched, same, "left_semi").groupBy(*IDENTITY).agg(F.max_by(F.struct(*columns), "change_seq").alias("w")).select("w.*", "route_id")
            feed = change_feed(known.unionByName(new), IDENTITY, ("ts", "node"), "arrival_seq")
            fresh = feed.where(F.col("change_seq") >= 2 * (done + 1)).withColumn("shard", placed(F.col("route_id")))
            fresh.hint("rebalance", "msg_type", "shard").write.mode("overwrite").partitionBy("msg_type", "shard").parquet(f"{self.path}/feed/epoch={done + 1}")
        self._set_mark("fed", there)

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self, folder: str) -> list[str]:
        at, fs = self._fs(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def _mark(self, name: str) -> int:
        """The highest number that a step has come to; -1 before the first."""
        return max((int(n) for n in self._names(f"marks/{name}")), default=-1)

    def _set_mark(self, name: str, value: int) -> None:
        older = [n for n in self._names(f"marks/{name}") if int(n) < value]
        at, fs = self._fs(f"{self.path}/marks/{name}/{value}")
        fs.create(at, True).close()
        for n in older:
            at, fs = self._fs(f"{self.path}/marks/{name}/{n}")
            fs.delete(at, False)

    def _schema(self):
        from pyspark.sql import types as T

        return T.StructType.fromDDL(RAW)

    def _changes(self, types: Sequence[str] | None = None, shards: Sequence[int] | None = None) -> DataFrame:
        """The feed's rows of some types and shards, with route_id; both prune."""
        schema = f"{RAW}, route_id bigint, weight int, change_seq bigint, shard int, epoch bigint"
        epochs = [n for n in self._names("feed") if n.startswith("epoch=") and int(n[6:]) <= self._mark("fed")]
        if not epochs:
            return self.spark.createDataFrame([], schema)
        out = self.spark.read.schema(schema).option("basePath", f"{self.path}/feed").parquet(*[f"{self.path}/feed/{e}" for e in epochs])
        if types is not None:
            out = out.where(F.col("msg_type").isin(sorted(set(types))))
        return out if shards is None else out.where(F.col("shard").isin(sorted(set(shards))))

    def versions(self) -> DataFrame:
        return self._versions().drop("route_id", "shard")

    def _versions(self) -> DataFrame:
        """With route_id, null in files of before it was kept, and shard."""
        schema = self._schema().add("route_id", LongType()).add("shard", IntegerType())
        if not self._names("versions"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/versions")

    def arrived(self) -> int:
        """The number of the last arrival, -1 without any."""
        return self._mark("reserved")

    def events(self) -> DataFrame:
        """The winners, with route_id and ord."""
        return winners(with_order(self.versions()), IDENTITY, ("ts", "node"))

    def event(self, sender: str, group: str, tx_id: int) -> DataFrame:
        """The winner of one identity: one shard of each type is read, and the identity is filtered at the scan."""
        own = self._versions().where((F.col("shard") == shard(F.lit(group))) & (F.col("group") == group) & (F.col("sender") == sender) & (F.col("tx_id") == tx_id))
        return winners(with_order(own.drop("route_id", "shard")), IDENTITY, ("ts", "node"))

    def find(self, identities: DataFrame) -> DataFrame:
        """The winners of identities (sender, group, tx_id): versions of no other are brought together."""
        own = self.versions().join(identities.select("sender", "group", "tx_id").distinct(), ["sender", "group", "tx_id"], "left_semi")
        return winners(with_order(own.select(*[f.name for f in self._schema()])), IDENTITY, ("ts", "node"))

    def feed(self, msg_type: str | None = None, group: str | None = None, cursor: int | None = None) -> DataFrame:
        """The signed feed, of a type, of a group and after a cursor where these are given; all three reach the scan."""
        out = self._changes(None if msg_type is None else [msg_type])
        if group is not None:
            out = out.where((F.col("shard") == shard(F.lit(group))) & (F.col("group") == group))
        if cursor is not None:
            out = out.where(F.col("change_seq") > cursor)
        return out.withColumn("ord", F.struct("ts", "route_id", "tx_id", "sender")).drop("shard", "epoch")

    def compact(self) -> None:
        """Write the feed's epochs as one."""
        epochs = sorted((n for n in self._names("feed") if n.startswith("epoch=")), key=lambda n: int(n[6:]))
        if len(epochs) > 1:
            whole = self._changes().drop("epoch")
            last = f"{self.path}/compacting"
            whole.hint("rebalance", "msg_type", "shard").write.mode("overwrite").partitionBy("msg_type", "shard").parquet(last)
            for n in epochs:
                at, fs = self._fs(f"{self.path}/feed/{n}")
                fs.delete(at, True)
            (source, fs), (target, _) = self._fs(last), self._fs(f"{self.path}/feed/{epochs[-1]}")
            fs.rename(source, target)

    def stream(self) -> DataFrame:
        """New versions as they are appended."""
        return self.spark.readStream.schema(self._schema().add("shard", IntegerType())).parquet(f"{self.path}/versions").drop("shard")


def shard(group: Column) -> Column:
    """The folder of a group within its type."""
    return placed(route_id(group))


def _route(kept: bool) -> Column:
    """The route of a group: the hash of a version is computed once, where it is first appended."""
    made = route_id(F.col("group"))
    return F.coalesce(F.col("route_id"), made) if kept else made


def placed(route: Column) -> Column:
    """The folder of a route within a type."""
    return F.pmod(route, F.lit(SHARDS)).cast("int")
