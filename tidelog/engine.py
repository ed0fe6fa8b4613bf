"""The engine: a log with its dimensions, event types and gears, in one folder that all nodes of a cluster see."""

from __future__ import annotations

import hashlib
from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.operators.gears import Gears
from tidelog.operators.routing import bucket, check_routable, content_hash, route_id
from tidelog.schema import EventTypes, LogError
from tidelog.sources import log


class RuleRuntime(ABC):
    """A rule with a state of its own choosing: what a gear is when it isn't one DataFrame expression.

    ``step`` gets the state that the last step returned and the net change since, and must give what one step over everything would. ``name`` is that of
    its state, which outlives the process.
    """

    @property
    def name(self) -> str:
        return type(self).__qualname__

    def meta(self) -> dict[str, str]:
        """What a node can say of the rule."""
        return {"name": self.name, "rule": (type(self).__doc__ or "").split("\n")[0]}

    def hash_data(self, content: Column) -> Column:
        """The hash under which the rule's data objects are known."""
        return content_hash(content)

    def route_group(self, group: Column) -> Column:
        """The route of a group of the rule's events, which places them."""
        return route_id(group)

    @abstractmethod
    def initial(self, spark: SparkSession) -> DataFrame: ...

    @abstractmethod
    def step(self, state: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(new state, output)."""


class Engine:
    """Opens, or makes, a node's log at ``path``. Tables are Parquet; dimensions are append-only like the log, and read deduplicated."""

    SHAPES = {"users": "user string", "senders": "sender string, user string, arrival bigint", "data": "ts bigint, hash string, content string"}

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.log = log.EventLog(spark, f"{self.path}/events")
        self.types, self.gears = EventTypes(), Gears()
        self._queries: list = []
        self._peers: list[Engine] = []

    # dimensions
    def _append(self, name: str, rows: DataFrame) -> None:
        shape = self.spark.createDataFrame([], self.SHAPES[name]).schema
        rows.select(*[F.col(f.name).cast(f.dataType) for f in shape]).write.mode("append").parquet(f"{self.path}/{name}")

    def _read(self, name: str) -> DataFrame:
        try:
            return self.spark.read.schema(self.SHAPES[name]).parquet(f"{self.path}/{name}")
        except Exception as missing:
            if "PATH_NOT_FOUND" in str(missing):
                return self.spark.createDataFrame([], self.SHAPES[name])
            raise

    def register_users(self, users: DataFrame) -> None:
        self._append("users", users.select("user"))

    def users(self) -> DataFrame:
        return self._read("users").distinct()

    def register_senders(self, senders: DataFrame) -> None:
        """``senders``: sender, user (or null) and arrival; a sender keeps the first user that it was bound to."""
        self._append("senders", senders)

    def senders(self) -> DataFrame:
        bound = self._read("senders")
        first = log.first_binding(bound.where("user is not null"), "sender", "user", "arrival")
        return bound.select("sender").distinct().join(first, "sender", "left")

    def register_data(self, ts: int, contents: DataFrame) -> DataFrame:
        """Stores contents (a column ``content``) and gives their ids (ts, hash); the same content again is the same object."""
        made = contents.select(F.lit(ts).cast("bigint").alias("ts"), content_hash(F.col("content")).alias("hash"), "content").distinct()
        self._append("data", made)
        return made.select("ts", "hash")

    def data(self) -> DataFrame:
        return log.data_objects(self._read("data"))

    def user_of(self, events: DataFrame) -> DataFrame:
        """Events with their sender's user; a sender without one is an error."""
        known = self.senders().where("user is not null").select(F.col("sender").alias("__sender"), "user")
        return log.resolve(events, known, F.col("sender") == F.col("__sender"), required=log.UnknownSender).drop("__sender")

    # writing
    def connect(self, *peers: Engine) -> None:
        """Nodes that get every batch which is posted here."""
        self._peers += peers

    def post(self, events: DataFrame, ts: int, forwarded_from: str | None = None, reply: Callable[[LogError | None], None] | None = None, **checks) -> None:
        """Append a batch: sender, tx_id, msg_type, group, body, node, arrival_seq. Refused whole if anything in it is unknown.

        Connected nodes pull it, unless it was ``forwarded_from`` another. With ``reply`` the outcome goes there, None or the error, instead of being raised.
        """
        try:
            self.types.freeze()
            self.log.post(events, ts, self.senders(), self.users(), declared=[t.name for t in self.types], **checks)
        except LogError as refused:
            if reply is None:
                raise
            return reply(refused)
        if forwarded_from is None:
            for peer in self._peers:
                peer.pull(self)
        if reply is not None:
            reply(None)

    def pull(self, *peers: Engine) -> None:
        """Append what peers got since the last pull and this log hasn't; it arrives here after all that is here. Deduplication makes all nodes converge,
        in whatever order. Of peers, only what arrived there since is read."""
        version = ["sender", "tx_id", "msg_type", "group", "ts", "node"]
        for peer in peers:
            for name in self.SHAPES:
                self._append(name, peer._read(name).exceptAll(self._read(name)))
            mark = f"pulled-{hashlib.sha256(peer.path.encode()).hexdigest()[:16]}"
            top = peer.log.arrived()
            new = peer.log._versions().drop("shard").where(F.col("arrival_seq") > self.log._mark(mark))
            with self.log.staged(new.join(self.log.versions().select(*version), version, "left_anti")) as fresh:
                self.log.append(fresh, routed=True)
            self.log._set_mark(mark, top)

    # reading
    def group_feed(self, msg_type: str, group: str | None = None, cursor: int | None = None) -> DataFrame:
        """The signed feed of a type or group, after a cursor if one is given."""
        return self.log.feed(msg_type, group, cursor)

    def event(self, sender: str, group: str, tx_id: int) -> DataFrame:
        """The winner of one identity, or no row."""
        return self.log.event(sender, group, tx_id)

    def run(self, gear: str, inputs: dict[str, DataFrame]) -> DataFrame:
        """A gear's converged output."""
        return self.gears.materialize(gear, inputs)

    def run_runtime(self, runtime: RuleRuntime, msg_type: str) -> DataFrame:
        """A stateful rule's output over what arrived since it last ran on this log, in this process or another."""
        base = f"states/{runtime.name}-{msg_type}"
        cursor = self.log._mark(f"{base}/done")
        top = 2 * self.log.arrived() + 1
        if cursor < 0:
            state = runtime.initial(self.spark)
        else:
            state = self.spark.read.parquet(f"{self.path}/{base}/at={cursor}")
        state, out = runtime.step(state, self.group_feed(msg_type, cursor=cursor))
        if top > cursor:
            # written, as a lazy state would be read again from a log that has grown since
            state.write.mode("overwrite").parquet(f"{self.path}/{base}/at={top}")
            self.log._set_mark(f"{base}/done", top)
        return out

    def partition_of(self, groups: DataFrame, group: str, partitions: int) -> DataFrame:
        """Route and partition of each group."""
        check_routable(groups.schema[group].dataType)
        return groups.withColumn("route_id", route_id(F.col(group))).withColumn("partition", bucket(F.col("route_id"), partitions))

    def watch(self, on_batch: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False):
        """Call ``on_batch`` with every batch of new versions: continuously, or for all there is now."""
        writer = self.log.stream().writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        query = (writer.trigger(availableNow=True) if once else writer).start()
        if once:
            query.awaitTermination()
        else:
            self._queries.append(query)
        return query

    def stop(self) -> None:
        """End what ``watch`` began; the session stays."""
        for query in self._queries:
            query.stop()
        self._queries.clear()

    def __enter__(self) -> Engine:
        return self

    def __exit__(self, *_) -> None:
        self.stop()
