import random

import pytest
from pyspark.sql import functions as F

from tidelog import streaming
from tidelog.operators import gears, stategraph, text, timeline
from tidelog.sources import log

ANCHOR_NONE = None


def rbac_events():
    a = [(4, None, 0, "Admin"), (5, 0, 1, "Moderator"), (6, 1, 1, "Admin"), (7, 1, 3, "Moderator"), (8, 0, 2, "Admin"), (9, 2, 1, "None"), (10, 2, 4, "Moderator")]
    return [("s", adm, t, lv, e) for e, adm, t, lv in a]


RBAC = "site string, admin bigint, target bigint, level string, event bigint"
RBAC_OUT = {(0, 4, "Admin"), (1, 5, "Moderator"), (1, 9, "None"), (2, 8, "Admin"), (4, 10, "Moderator")}


def test_access_levels(spark):
    out = gears.access_levels(spark.createDataFrame(rbac_events(), RBAC))
    assert {(r.key, r.event, r.value) for r in out.collect()} == RBAC_OUT


def pure_fold(events, handler):
    rows = sorted((dict(zip(("site", "admin", "target", "level", "event"), e)) for e in events), key=lambda e: e["event"])
    return {(key, e["event"], value) for e, writes in stategraph.run_events(rows, handler) for key, value in writes.items()}


def test_access_levels_do_not_depend_on_order_or_batches():
    def handler(ctx, e):
        if e["admin"] is None or e["admin"] != e["admin"] or ctx.query(int(e["admin"])) == "Admin":
            ctx.update(int(e["target"]), e["level"])

    for seed in range(200):
        rows = rbac_events()
        random.Random(seed).shuffle(rows)
        assert pure_fold(rows, handler) == RBAC_OUT


def set_copy(ctx, e):
    if e["op"] == "set":
        ctx.update("x", e["n"])
    elif e["op"] == "copy_xy" and ctx.query("x") is not None:
        ctx.update("y", ctx.query("x") + e["n"])
    elif e["op"] == "copy_yz" and ctx.query("y") is not None:
        ctx.update("z", ctx.query("y") + e["n"])
    elif e["op"] == "double" and (ctx.query("x") or 0) > 0:
        ctx.update("y", 2 * ctx.query("x"))
    elif e["op"] == "own":
        ctx.update("x", 99)
        ctx.update("saw", ctx.query("x"))


@pytest.mark.parametrize(
    "events, expected",
    [
        ([("set", 42)], {"x": 42}),
        ([("set", 10), ("copy_xy", 1)], {"x": 10, "y": 11}),
        ([("set", 20), ("copy_xy", 1), ("copy_yz", 1)], {"x": 20, "y": 21, "z": 22}),
        ([("copy_xy", 1)], {}),
        ([("set", 5), ("double", 0)], {"x": 5, "y": 10}),
        ([("set", -1), ("double", 0)], {"x": -1}),
        ([("set", 42), ("own", 0)], {"x": 99, "saw": 42}),
    ],
)
def test_rules_of_the_fold(spark, events, expected):
    df = spark.createDataFrame([("g", k, op, n) for k, (op, n) in enumerate(events)], "g string, at bigint, op string, n bigint")
    last = timeline.last(stategraph.fold(df, set_copy, ["g"], ["at"], "string", "bigint"), ["key"], "at")
    assert {r.key: r.value for r in last.collect()} == expected


def test_bounded_replay(spark):
    writes = spark.createDataFrame([("x", 1, 20), ("x", 5, 99)], "key string, ord bigint, value bigint")
    reads = spark.createDataFrame([("x", 2), ("x", 3), ("x", 5), ("x", 7)], "key string, ord bigint")
    hit = stategraph.affected_readers(reads, writes, writes.where("ord = 1"), ["key"])
    assert sorted(r.ord for r in hit.collect()) == [2, 3, 5]
    seen = timeline.latest_before(reads.where("ord <> 5"), writes, ["key"])
    assert {(r.ord, r.latest) for r in seen.collect()} == {(2, 20), (3, 20), (7, 99)}


def test_dependencies_are_read_inclusively_and_apart(spark):
    events = spark.createDataFrame([("d", 1, 10, 5, 42), ("d", 2, 20, 7, 19)], "g string, at bigint, branch bigint, usr bigint, n bigint")
    deps = spark.createDataFrame([("d", "inv", "10|5", True, 1), ("d", "inv", "20|7", True, 1), ("d", "inv", "10|5", False, 2), ("d", "inv", "20|7", False, 3)], "g string, dep string, dep_key string, dep_value boolean, at bigint")

    def handler(ctx, e):
        if ctx.dep_query("inv", f"{e['branch']}|{e['usr']}"):
            ctx.update(str(e["branch"]), e["n"])

    got = stategraph.fold(events, handler, ["g"], ["at"], "string", "bigint", deps)
    assert {(r.key, r.value) for r in got.collect()} == {("10", 42), ("20", 19)}
    gone = stategraph.fold(events, handler, ["g"], ["at"], "string", "bigint", deps.where("dep_key <> '10|5' or not dep_value"))
    assert {(r.key, r.value) for r in gone.collect()} == {("20", 19)}


def invite(ts, user, invitee, branch="b0", tx=0, creator="alice"):
    return (branch, creator, user, invitee, ts, 0, tx, user)


INVITE = "branch string, creator string, user string, invitee string, ts bigint, route_id bigint, tx_id bigint, sender string"
ATTACH = f"doc bigint, branch string, creator string, user string, is_merge boolean, edit {text.TEXT_UPDATE}, from_branch string, ts bigint, route_id bigint, tx_id bigint, sender string"


def write(ts, user, words, branch="b0", tx=0, creator="alice"):
    edit = ([(None, 0)], [words], [])
    return (1, branch, creator, user, False, edit, None, ts, 7, tx, user)


def documents(spark, invites, attaches):
    members = gears.invited(spark.createDataFrame(invites, INVITE))
    return {r.branch: r.text for r in gears.doc_content(spark.createDataFrame(attaches, ATTACH), members)[1].collect()}


def test_membership(spark):
    out = gears.invited(spark.createDataFrame([invite(1, "alice", "bob", tx=0), invite(1, "alice", "carol", tx=1), invite(1, "bob", "carol", tx=2)], INVITE))
    assert {(r.key, r.value) for r in timeline.last(out.withColumn("ord", F.struct(*gears.ORDER)), ["key"]).collect()} == {("bob", True), ("carol", True)}


def test_only_members_write(spark):
    assert documents(spark, [invite(1, "alice", "bob")], [write(2, "bob", "Hello from Bob", tx=1), write(3, "eve", "spam", tx=2)]) == {"b0": "Hello from Bob"}


def test_late_invitations_count_from_then_on(spark):
    invites = [invite(2, "alice", "bob"), invite(5, "alice", "carol", tx=4), invite(6, "bob", "dave", tx=5)]
    attaches = [write(3, "bob", "Hello from Bob", tx=2), write(4, "carol", "too early", tx=3), write(7, "dave", "Dave says hi", tx=6), write(8, "eve", "never", tx=7)]
    random.Random(1).shuffle(attaches)
    assert documents(spark, invites, attaches) == {"b0": "Dave says hiHello from Bob"}
    assert documents(spark, [invite(24, "alice", "bob")], [write(23, "bob", "Bob before invite", tx=1), write(25, "bob", "Bob after invite", tx=2)]) == {"b0": "Bob after invite"}


def test_branches_merge(spark):
    merge = (1, "b0", "alice", "alice", True, None, "b1", 13, 7, 4, "alice")
    attaches = [write(11, "alice", "AAA", tx=2), write(12, "carol", "BBB", "b1", 3, "carol"), merge, write(14, "eve", "no", "b1", 5, "carol")]
    assert documents(spark, [invite(99, "alice", "nobody")], attaches) == {"b0": "BBBAAA", "b1": "BBB"}


def test_many_authors(spark):
    invites = [invite(16, "alice", u, tx=k) for k, u in enumerate(("bob", "carol", "dave"))]
    attaches = [write(17, "alice", "Hello", tx=3), write(18, "bob", "World", tx=4), write(19, "carol", "!", tx=5), write(20, "dave", " [Dave]", tx=6), write(21, "eve", "[ignored]", tx=7)]
    assert documents(spark, invites, attaches) == {"b0": " [Dave]!WorldHello"}


def test_linear_gears(spark):
    feed = spark.createDataFrame([(0, 3, 4, 1), (0, 5, 2, 1)], "bucket int, a bigint, b bigint, weight int")
    assert gears.mulsum(feed).first().total == 22
    more = feed.union(spark.createDataFrame([(0, 7, 1, 1)], feed.schema))
    assert gears.mulsum(more).first().total == 29
    assert gears.mulsum(more.union(spark.createDataFrame([(0, 5, 2, -1)], feed.schema))).first().total == 19
    inv = spark.createDataFrame([("b0", 1), ("b0", 1), ("b0", 1), ("b1", 1)], "branch string, weight int")
    assert {r.branch: r.invites for r in gears.invites_count(inv).collect()} == {"b0": 3, "b1": 1}
    rules = gears.standard_gears()
    assert rules.order("doc_content") == ["invited", "doc_content"]
    assert rules.materialize("mulsum", {"MulSumEntry": feed}).first().total == 22


def test_timeline_primitives(spark):
    t = spark.createDataFrame([("k", o, o * 10) for o in range(0, 10, 2)], "key string, ord bigint, value bigint")
    at = spark.createDataFrame([("k", o) for o in (-1, 0, 3, 4, 99)], "key string, ord bigint")
    assert {r.ord: r.latest for r in timeline.latest_at(at, t, ["key"]).collect()} == {-1: None, 0: 0, 3: 20, 4: 40, 99: 80}
    assert {r.ord: r.latest for r in timeline.latest_before(at, t, ["key"]).collect()} == {-1: None, 0: None, 3: 20, 4: 20, 99: 80}
    assert {r.ord: r.next_ord for r in timeline.next_after(t, ["key"]).collect()} == {0: 2, 2: 4, 4: 6, 6: 8, 8: None}
    assert (timeline.first(t, ["key"]).first().value, timeline.last(t, ["key"]).first().value) == (0, 80)
    bounds = spark.createDataFrame([("k", 2, 6)], "key string, low bigint, high bigint")
    assert sorted(r.write_ord for r in timeline.range_between(bounds, t, ["key"], "low", "high").collect()) == [4, 6]
    assert sorted(r.write_ord for r in timeline.range_between(bounds, t, ["key"], "low", None).collect()) == [4, 6, 8]
    new = timeline.insert(t, spark.createDataFrame([("k", 4, -4), ("k", 5, 5)], t.schema), ["key"])
    assert {(r.ord, r.value) for r in new.collect()} == {(0, 0), (2, 20), (4, -4), (5, 5), (6, 60), (8, 80)}
    less = timeline.remove(new, spark.createDataFrame([("k", 0)], "key string, ord bigint"), ["key"])
    changes = timeline.diff(t, less, ["key"])
    assert {(r.ord, r.change) for r in changes.collect()} == {(0, "remove"), (4, "update"), (5, "add")}
    assert timeline.diff(timeline.apply_diff(t, changes, ["key"]), less, ["key"]).count() == 0
    assert [r.change for r in timeline.key_diff(t, less, ["key"]).collect()] == ["changed"]
    assert timeline.contains(t, at, ["key"]).count() == 2 and timeline.get(t, at, ["key"]).count() == 2
    assert timeline.sizes(t, ["key"]).first()["size"] == 5 and timeline.keys(t, ["key"]).count() == 1
    assert timeline.remap(t, lambda v: v + 1).agg(F.min("value")).first()[0] == 1
    assert timeline.same_events(t, ["key"]).count() == 5 and timeline.history(t, F.col("key") == "k").count() == 5


def test_streamed_feed_and_views_equal_the_full_result(spark, tmp_path):
    rows = [(1, 1, 9, 10), (1, 2, 4, 5), (1, 1, 3, 7), (2, 1, 1, 100), (1, 1, 8, 1), (2, 1, 2, 3)]
    schema = "usr bigint, tx bigint, ts bigint, cents bigint"
    source, view = str(tmp_path / "in"), streaming.LinearView(spark, str(tmp_path / "view"), ["usr"], "cents", "total")
    for part in (rows[:2], rows[2:4], rows[4:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        streaming.run(streaming.winner_changes(stream, ["usr", "tx"], ["ts"], ["cents"]), view, str(tmp_path / "check"))
    got = {r.usr: r.total for r in view.current().collect()}
    full = log.winners(spark.createDataFrame(rows, schema), ["usr", "tx"], ["ts"]).groupBy("usr").agg(F.sum("cents").alias("t"))
    assert got == {r.usr: r.t for r in full.collect()} == {1: 12, 2: 100}


def test_fold_view_replays_late_events(spark, tmp_path):
    schema = "g string, at bigint, op string, n bigint, weight int"
    view = streaming.FoldView(spark, str(tmp_path / "fold"), set_copy, ["g"], ["at"], "string", "bigint")
    view.apply(spark.createDataFrame([("a", 2, "copy_xy", 1, 1), ("a", 3, "copy_yz", 1, 1), ("b", 1, "set", 5, 1)], schema), 0)
    assert {(r.g, r.key) for r in view.timeline().collect()} == {("b", "x")}
    view.apply(spark.createDataFrame([("a", 1, "set", 10, 1)], schema), 1)
    assert {(r.g, r.key, r.value) for r in view.timeline().collect()} == {("a", "x", 10), ("a", "y", 11), ("a", "z", 12), ("b", "x", 5)}
    assert {(r.key, r.change) for r in view.changes(1).collect()} == {("x", "add"), ("y", "add"), ("z", "add")}
    view.apply(spark.createDataFrame([("a", 1, "set", 10, -1), ("a", 1, "set", 20, 1)], schema), 2)
    assert {(r.key, r.change, r.new_value) for r in view.changes(2).collect()} == {("x", "update", 20), ("y", "update", 21), ("z", "update", 22)}
    view.apply(spark.createDataFrame([("a", 1, "set", 20, -1)], schema), 3)
    assert {(r.g, r.key) for r in view.timeline().collect()} == {("b", "x")}
    view.apply(spark.createDataFrame([("a", 1, "set", 20, -1)], schema), 3)  # the same epoch again
    assert {(r.g, r.key) for r in view.timeline().collect()} == {("b", "x")}
    view.compact()
    again = streaming.FoldView(spark, str(tmp_path / "fold"), set_copy, ["g"], ["at"], "string", "bigint")
    assert {(r.g, r.key) for r in again.timeline().collect()} == {("b", "x")}
    again.apply(spark.createDataFrame([("a", 0, "set", 7, 1)], schema), 4)
    assert {(r.g, r.key, r.value) for r in again.timeline().collect()} == {("a", "x", 7), ("a", "y", 8), ("a", "z", 9), ("b", "x", 5)}


def test_a_fold_holds_state_not_events(spark):
    """A group's rows stream past the handler: its memory is the state, whatever the group's size."""
    rows = spark.range(60_000).select(F.lit("g").alias("g"), F.col("id").alias("at"), (F.col("id") % 7).alias("k"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("n"))

    def handler(ctx, e):
        if e["n"] is not None:
            ctx.update(e["k"], (ctx.query(e["k"]) or 0) + 1)

    out = stategraph.fold(rows, handler, ["g"], ["at"], "bigint", "bigint")
    assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    assert out.count() == 40_000
    assert {r.key: r.n for r in out.groupBy("key").agg(F.max("value").alias("n")).collect()} == {k: sum(1 for i in range(60_000) if i % 7 == k and i % 3) for k in range(7)}


def test_dependencies_and_starts_come_before_events(spark):
    events = spark.createDataFrame([("g", 1, "a"), ("g", 5, "a"), ("h", 5, "a"), ("g", 9, "b")], "g string, at bigint, k string")
    deps = spark.createDataFrame([("g", "d", "a", "one", 1), ("g", "d", "a", "five", 5), ("g", "d", "b", None, 2)], "g string, dep string, dep_key string, dep_value string, at bigint")
    out = stategraph.fold(events, lambda ctx, e: ctx.update(e["k"], f"{ctx.dep_query('d', e['k'])}/{ctx.query(e['k'])}"), ["g"], ["at"], dependencies=deps)
    assert {(r.g, r.at, r.key, r.value) for r in out.collect()} == {("g", 1, "a", "one/None"), ("g", 5, "a", "five/one/None"), ("h", 5, "a", "None/None"), ("g", 9, "b", "None/None")}


def test_affected_readers_meet_one_write_each(spark):
    rng = random.Random(3)
    writes = [(k, t) for k in range(3) for t in rng.sample(range(0, 100, 2), 20)]
    reads = [(k, t, i) for i, (k, t) in enumerate((rng.randrange(3), rng.randrange(100)) for _ in range(200))]
    changed = rng.sample(writes, 15)
    got = stategraph.affected_readers(spark.createDataFrame(reads, "k bigint, ord bigint, id bigint"), spark.createDataFrame(writes, "k bigint, ord bigint"), spark.createDataFrame(changed, "k bigint, ord bigint"), ["k"])
    want = set()
    for k, t, i in reads:
        earlier = [w for w in writes if w[0] == k and w[1] < t]
        if earlier and max(earlier) in changed:
            want.add(i)
    assert {r.id for r in got.collect()} == want and "CartesianProduct" not in got._jdf.queryExecution().toString()
