import pytest
from pyspark.sql import functions as F

from tidelog.operators import gears, routing
from tidelog.schema import ContentMismatch, EventTypes, ForwardReference, GearError, LogError, RoutingError, UnknownData, UnknownSender, UnknownUser
from tidelog.sources import log


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("alice", "u1"), ("bob", "u2")], "sender string, user string"), spark.createDataFrame([("u1",), ("u2",)], "user string")


def counter_events(spark, rows):
    return spark.createDataFrame([(s, t, "Attach", g, b, n, a) for s, t, g, b, n, a in rows], "sender string, tx_id bigint, msg_type string, `group` string, body string, node int, arrival_seq bigint")


def totals(eventlog):
    feed = eventlog.feed().withColumns({"doc": F.split("group", ",")[0], "branch": F.split("group", ",")[1], "delta": F.col("body").cast("bigint")})
    return {(r.doc, r.branch): r.total for r in gears.doc_counter(feed).collect()}


def test_counter_accumulates_over_batches_and_nodes(spark, tmp_path, people):
    eventlog = log.EventLog(spark, str(tmp_path / "log"))
    assert eventlog.versions().count() == 0
    eventlog.post(counter_events(spark, [("alice", 0, "42,0", "5", 0, 0), ("bob", 1, "42,0", "-2", 0, 1)]), 2, *people)
    assert totals(eventlog) == {("42", "0"): 3}
    eventlog.post(counter_events(spark, [("alice", 2, "42,0", "7", 1, 2)]), 3, *people)
    assert totals(eventlog) == {("42", "0"): 10}
    eventlog.post(counter_events(spark, [("alice", 2, "99,0", "42", 1, 3)]), 4, *people)
    assert totals(eventlog) == {("42", "0"): 10, ("99", "0"): 42}, "one transaction number in two groups is two events"


def test_a_bad_batch_is_refused_whole(spark, tmp_path, people):
    senders, users = people
    eventlog = log.EventLog(spark, str(tmp_path / "log"))
    with pytest.raises(UnknownSender):
        eventlog.post(counter_events(spark, [("alice", 0, "1,0", "1", 0, 0), ("eve", 1, "1,0", "1", 0, 1)]), 1, senders, users)
    stray = spark.createDataFrame([("alice", "u9")], "sender string, user string")
    with pytest.raises(UnknownUser):
        eventlog.post(counter_events(spark, [("alice", 0, "1,0", "1", 0, 0)]), 1, stray, users)
    with_refs = counter_events(spark, [("alice", 0, "1,0", "1", 0, 0)]).withColumns({"who": F.array(F.lit("u7")), "what": F.array(F.lit("h9"))})
    with pytest.raises(UnknownUser):
        eventlog.post(with_refs, 1, senders, users, user_refs="who")
    data = spark.createDataFrame([("h1", 0, [0])], "hash string, position int, refs array<int>")
    with pytest.raises(ForwardReference):
        eventlog.post(with_refs, 1, senders, users, data=data)
    good = spark.createDataFrame([("h1", 0, []), ("h2", 1, [0])], "hash string, position int, refs array<int>")
    with pytest.raises(UnknownData):
        eventlog.post(with_refs, 1, senders, users, data=good, data_refs="what")
    assert eventlog.versions().count() == 0


def test_earliest_version_wins_in_any_order(spark):
    rows = [("a", 1, 5, 0, "late", 0), ("a", 1, 3, 2, "mid", 1), ("a", 1, 3, 1, "first", 2), ("a", 1, 9, 0, "later", 3), ("a", 2, 1, 0, "other", 4)]
    v = spark.createDataFrame(rows, "sender string, tx bigint, ts bigint, node int, body string, seq bigint")
    assert {(r.tx, r.body) for r in log.winners(v, ["sender", "tx"], ["ts", "node"]).collect()} == {(1, "first"), (2, "other")}
    feed = log.change_feed(v, ["sender", "tx"], ["ts", "node"], "seq")
    assert [(r.body, r.weight) for r in feed.orderBy("change_seq").collect()] == [("late", 1), ("late", -1), ("mid", 1), ("mid", -1), ("first", 1), ("other", 1)]
    net = log.delta_since(feed, F.lit(1), ["tx", "body"])
    assert {(r.body, r.weight) for r in net.collect()} == {("late", -1), ("first", 1), ("other", 1)}
    assert {r.body for r in log.delta_since(feed, F.lit(-1), ["tx", "body"]).collect()} == {"first", "other"}


def test_data_objects_are_content_addressed(spark):
    made = spark.createDataFrame([(1, "x"), (1, "x")], "ts bigint, content string").withColumn("hash", routing.content_hash(F.col("content")))
    assert log.data_objects(made).count() == 1
    with pytest.raises(ContentMismatch):
        log.data_objects(made.withColumn("hash", F.lit("00")))


def test_nested_values_have_different_forms(spark):
    df = spark.createDataFrame([([[1], [2]], [[1, 2]])], "a array<array<int>>, b array<array<int>>")
    r = df.select(routing.content_hash(F.col("a")).alias("a"), routing.content_hash(F.col("b")).alias("b")).first()
    assert r.a != r.b
    with pytest.raises(RoutingError):
        routing.check_routable(spark.createDataFrame([({"a": 1},)], "m map<string,int>").schema["m"].dataType)


def test_jump_hash_moves_few_keys():
    import numpy as np

    keys = np.arange(20000) * 2654435761 % 2**32
    a, b = routing.jump_hash(keys, 10), routing.jump_hash(keys, 11)
    assert a.min() == 0 and a.max() == 9
    moved = a != b
    assert 0.05 < moved.mean() < 0.14 and set(b[moved]) == {10}


def test_event_types_and_gears_are_checked():
    types = EventTypes()
    types.register("Invite", "branch string", "user string")
    with pytest.raises(LogError):
        types.register("Invite", "branch string", "user string")
    types.freeze()
    with pytest.raises(LogError):
        types.register("Late", "x int", "y int")
    with pytest.raises(LogError):
        types["Missing"]
    rules = gears.Gears()
    rules.register(gears.Gear("a", "T", lambda p, b: p, ("b",)))
    with pytest.raises(GearError, match="cycle"):
        rules.register(gears.Gear("b", "T", lambda p, a: p, ("a",)))
    with pytest.raises(GearError):
        rules.materialize("a", {})


def test_resolve_fails_on_a_missing_row(spark):
    rows, table = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1, "x")], "id int, v string")
    assert log.resolve(rows, table, F.col("k") == F.col("id")).count() == 2
    with pytest.raises(Exception, match="UnknownData"):
        log.resolve(rows, table, F.col("k") == F.col("id"), required=UnknownData).collect()


def test_a_posted_batch_is_computed_once(spark, tmp_path, people):
    import os

    context = spark.sparkContext
    seen = context.accumulator(0)

    def counted(row):
        seen.add(1)
        return row

    few = counter_events(spark, [("alice", k, f"{k % 2},0", "1", 0, k) for k in range(6)])
    events = spark.createDataFrame(context.parallelize([tuple(r) for r in few.collect()], 2).map(counted), few.schema)
    eventlog = log.EventLog(spark, str(tmp_path / "log"))
    eventlog.post(events, 1, *people)
    assert seen.value == 6 and eventlog.feed().count() == 6
    with pytest.raises(UnknownSender):
        eventlog.post(few.withColumn("sender", F.lit("eve")), 2, *people)
    assert not os.listdir(tmp_path / "log" / "staged")


def test_versions_of_before_routes_were_kept_are_fed(spark, tmp_path, people):
    new, old = (log.EventLog(spark, str(tmp_path / n)) for n in ("new", "old"))
    new.post(counter_events(spark, [("alice", k, f"{k},0", "1", 0, k) for k in range(4)]), 1, *people)
    new._versions().drop("route_id").write.partitionBy("msg_type", "shard").parquet(f"{old.path}/versions")
    old._set_mark("reserved", new.arrived())
    old._follow()
    rows = lambda df: sorted(map(tuple, df.select("sender", "route_id", "tx_id", "body", "weight", "change_seq").collect()))
    assert rows(old.feed()) == rows(new.feed()) and len(rows(old.feed())) == 4
