"""Queries of whole nodes, of rules with state and views, and of the smaller parts of the vocabulary, with their SQL.

A node's log has the events table as its events: the sender is the user, the group the event type, the body the value in cents. Nodes are made anew in the
shared folder for each run.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog import streaming
from tidelog.engine import Engine, RuleRuntime
from tidelog.operators import gears, routing, stategraph, timeline
from tidelog.plans.registry import IDENTITY, V, _feed, _query, _table, _timeline, _two, _TWO, _versions
from tidelog.schema import EventTypes, LogError, Records
from tidelog.shared import shared_folder
from tidelog.sources import log


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/tidelog-{name}-{uuid.uuid4().hex}"


def _rows(spark, sf_dir) -> DataFrame:
    """The events table as rows of a log; the last events arrive first."""
    v = _versions(spark, sf_dir)
    return v.select(
        F.col("user_id").cast("string").alias("sender"), F.col("tx").alias("tx_id"), F.lit("Event").alias("msg_type"), F.col("event_type").alias("group"),
        F.col("cents").cast("string").alias("body"), F.col("event_id").alias("ts"), F.lit(1).alias("node"), F.col("arrival").alias("arrival_seq"),
    )


def _node(spark, sf_dir, name: str) -> Engine:
    """A node that knows every user, and every user as a sender."""
    engine = Engine(spark, _folder(spark, name))
    engine.types.register("Event", "kind string", "cents string")
    users = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("user")).distinct()
    engine.register_users(users)
    engine.register_senders(users.select(F.col("user").alias("sender"), "user", F.lit(0).alias("arrival")))
    return engine


class Total(RuleRuntime):
    """The sum of cents of each sender, kept by adding what a delta says."""

    def initial(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([], "sender string, total bigint")

    def step(self, state: DataFrame, delta: DataFrame) -> tuple[DataFrame, DataFrame]:
        own = delta.groupBy("sender").agg(F.sum(F.col("body").cast("bigint") * F.col("weight")).alias("total"))
        now = gears.apply_linear(state, own, ["sender"], "total")
        return now, now


# --- nodes -----------------------------------------------------------------------------------------------------


@_query(V + "select cast(user_id as varchar) as sender, cast(sum(cents) as bigint) as total from winners group by 1")
def engine_incremental(spark, sf_dir):
    """A rule's state over two nodes: it runs, the node pulls earlier versions of what it has and more, and it runs on; equals the full sum."""
    rows = _rows(spark, sf_dir)
    with _node(spark, sf_dir, "a") as one, _node(spark, sf_dir, "b") as two:
        one.log.append(rows.where("ts % 3 <> 1"))
        two.log.append(rows.where("ts % 3 <> 0"))
        one.run_runtime(Total(), "Event")
        one.pull(two)
        return one.run_runtime(Total(), "Event")


@_query(V + """, v as (
  select user_id, event_type, tx, min(event_id) as event_id from versions where event_id % 2 = 1 group by all
  union all
  select user_id, event_type, tx, min(event_id) from versions where event_id % 2 = 0 group by all
  having (user_id, event_type, tx) not in (select (user_id, event_type, tx) from versions where event_id % 2 = 1)
)
select v.event_type as "group", cast(count(*) as bigint) as invites, cast(sum(x.cents) as bigint) as cents from v join versions x on x.event_id = v.event_id group by 1""")
def engine_post(spark, sf_dir):
    """Batches posted to one node, the later one with an earlier time, as a node sees them that is connected to it: a registered rule's output there."""
    rows = _rows(spark, sf_dir)
    first = lambda df: df.groupBy("sender", "group", "tx_id").agg(F.min_by(F.struct(*[c for c in df.columns if c not in ("sender", "group", "tx_id")]), "ts").alias("w")).select("sender", "group", "tx_id", "w.*").drop("ts")
    said: list = []
    with _node(spark, sf_dir, "a") as one, _node(spark, sf_dir, "b") as two:
        one.connect(two)
        one.post(first(rows.where("ts % 2 = 0")), 7, reply=said.append)
        one.post(first(rows.where("ts % 2 = 1")), 3, reply=said.append)
        one.post(rows.limit(1).withColumn("sender", F.lit("nobody")).drop("ts"), 1, reply=said.append)
        if [type(s).__name__ for s in said] != ["NoneType", "NoneType", "UnknownSender"]:
            raise LogError(f"replies were {said}")
        two.gears.register(gears.Gear("count", "Event", lambda feed: gears.invites_count(feed, "group")))
        two.gears.register(gears.Gear("worth", "Event", lambda feed, count: count.join(gears.diff_fold(feed, ["group"], F.col("body").cast("bigint"), "cents"), "group"), ("count",)))
        return two.run("worth", {"Event": two.group_feed("Event")})


@_query(V + """select cast(user_id as varchar) as sender, tx as tx_id, event_id as ts, cast(cents as varchar) as body from winners
where (user_id, event_type, tx) = (select (user_id, event_type, tx) from versions where event_id = (select max(event_id) from versions))""")
def engine_point_lookup(spark, sf_dir):
    """The winner of one identity, that of the last event; its shard is all that is read."""
    engine = _node(spark, sf_dir, "a")
    rows = _rows(spark, sf_dir)
    engine.log.append(rows)
    last = rows.orderBy(F.desc("ts")).first()
    return engine.event(last.sender, last.group, last.tx_id).select("sender", "tx_id", "ts", "body")


@_query(V + """select cast(user_id as varchar) as sender, event_type as "group", tx as tx_id, event_id as ts from winners
where (user_id, tx) in (select (user_id, tx) from versions where event_type = 'error')""")
def engine_find(spark, sf_dir):
    """The winners of every sender and transaction that an error has, in all groups."""
    engine = _node(spark, sf_dir, "a")
    rows = _rows(spark, sf_dir)
    engine.log.append(rows)
    wanted = rows.where(F.col("group") == "error").select("sender", "tx_id").distinct()
    return engine.log.find(rows.select("sender", "group", "tx_id").join(wanted, ["sender", "tx_id"], "left_semi")).select("sender", "group", "tx_id", "ts")


@_query("select event_type as kind, count(*) as n from events group by 1")
def engine_watch(spark, sf_dir):
    """A worker that is called with every batch of new versions and keeps counts."""
    engine, counts = _node(spark, sf_dir, "a"), _folder(spark, "counts")
    rows = _rows(spark, sf_dir)
    work = lambda batch, epoch: batch.groupBy(F.col("group").alias("kind")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{counts}/epoch={epoch}")
    seen = _folder(spark, "watched")
    for half in (0, 1):  # the second time it goes on where it was
        engine.log.append(rows.where(F.col("ts") % 2 == half))
        engine.watch(work, seen, once=True).stop()
    return spark.read.parquet(counts).groupBy("kind").agg(F.sum("n").alias("n"))


@_query("select sha256('{\"v\":\"' || p_name || '\"}') as hash, p_name as content from (select distinct p_name from part)")
def data_registration(spark, sf_dir):
    """Contents registered twice are one object each, under the hash of their canonical form."""
    engine = _node(spark, sf_dir, "a")
    parts = _table(spark, sf_dir, "part").select(F.col("p_name").alias("content"))
    engine.register_data(5, parts)
    engine.register_data(5, parts.limit(100))
    return engine.data().select("hash", "content")


@_query("select event_id, cast(user_id as varchar) as sender, (select arg_min(event_type, event_id) from events f where f.user_id = e.user_id) as usr from events e")
def users_of_senders(spark, sf_dir):
    """The user of every event's sender, who is the first that the sender was bound to."""
    engine = Engine(spark, _folder(spark, "a"))
    e = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("string").alias("sender"), F.col("event_type").alias("user"))
    engine.register_users(e.select("user"))
    engine.register_senders(e.select("sender", "user", F.col("event_id").alias("arrival")))
    return engine.user_of(e.drop("user")).select("event_id", "sender", F.col("user").alias("usr"))


@_query("""select * from (values ('an event type declared after the log opened', 'LogError'), ('an event type declared twice', 'LogError'), ('an event type that is not there', 'LogError'),
 ('a cycle of rules', 'GearError'), ('a rule that is not there', 'GearError'), ('a rule defined twice', 'GearError'), ('a rule that reads one which is not there', 'GearError'), ('an unknown sender', 'UnknownSender'),
 ('an unknown user', 'UnknownUser'), ('an unknown data object', 'UnknownData'), ('a reference forward', 'ForwardReference'),
 ('content that is not its hash', 'ContentMismatch'),
 ('a group without canonical form', 'RoutingError'), ('a function that is not there', 'EvaluationError'), ('a loop beyond its bound', 'EvaluationError')) as t(what, error)""")
def refusals(spark, sf_dir):
    """What the engine refuses, and with which error."""
    types, rules, rows = EventTypes(), gears.Gears(), _rows(spark, sf_dir).limit(1)
    types.register("A", "x int", "y int")
    types.freeze()
    twice = EventTypes()
    twice.register("A", "x int", "y int")
    rules.register(gears.Gear("a", "T", lambda p, b: p, ("b",)))
    people = rows.select("sender", F.col("sender").alias("user"))
    nobody, data = people.limit(0), spark.createDataFrame([("h", 0, [0])], "hash string, position int, refs array<int>")
    wrong = spark.createDataFrame([(1, "00", "x")], "ts bigint, hash string, content string")
    what = {
        "an event type declared after the log opened": lambda: types.register("B", "x int", "y int"),
        "an event type declared twice": lambda: twice.register("A", "x int", "y int"),
        "an event type that is not there": lambda: types["C"],
        "a cycle of rules": lambda: rules.register(gears.Gear("b", "T", lambda p, a: p, ("a",))),
        "a rule that is not there": lambda: rules.materialize("c", {}),
        "a rule defined twice": lambda: rules.register(gears.Gear("a", "T", lambda p: p)),
        "a rule that reads one which is not there": lambda: rules.materialize("a", {}),
        "an unknown sender": lambda: log.validate(rows, nobody, nobody),
        "an unknown user": lambda: log.validate(rows, people, nobody),
        "an unknown data object": lambda: log.validate(rows.withColumn("d", F.array(F.lit("none"))), people, people, data.withColumn("refs", F.array().cast("array<int>")), data_refs="d"),
        "a reference forward": lambda: log.validate(rows, people, people, data),
        "content that is not its hash": lambda: log.data_objects(wrong),
        "a group without canonical form": lambda: routing.check_routable(spark.createDataFrame([], "m map<string,int>").schema["m"].dataType),
        "a function that is not there": lambda: fn.lookup("nothing"),
        "a loop beyond its bound": lambda: fn.loop(0, lambda again, s: again(s), most=3),
    }
    found = []
    for name, attempt in what.items():
        try:
            attempt()
            found.append((name, "none"))
        except LogError as error:
            found.append((name, type(error).__name__))
    return spark.createDataFrame(found, "what string, error string")


@_query("select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, l_partkey % 7 as ref from lineitem where l_partkey % 7 >= l_linenumber")
def forward_refs(spark, sf_dir):
    """References of data objects to themselves or to later ones."""
    items = _table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.array(F.col("l_orderkey") * 10 + F.col("l_partkey") % 7).alias("refs"))
    return log.forward_references(items).select(F.floor(F.col("position") / 10).alias("l_orderkey"), (F.col("position") % 10).alias("l_linenumber"), (F.col("ref") % 10).alias("ref"))


# --- rules -----------------------------------------------------------------------------------------------------


@_query(V + "select event_type, cast(count(*) as bigint) as invites, cast(count(*) as double) / (select count(*) from winners) as share from winners group by 1")
def gear_of_gears(spark, sf_dir):
    """A rule that reads another's output: each branch's share of all invitations, materialised by name."""
    rules = gears.Gears()
    # the whole is one row, so this product is as long as the rule's output
    share = lambda feed, count: count.crossJoin(F.broadcast(count.agg(F.sum("invites").alias("whole")))).select("event_type", "invites", (F.col("invites") / F.col("whole")).alias("share"))
    rules.register(gears.Gear("share", "Event", share, ("count",)))
    rules.register(gears.Gear("count", "Event", lambda feed: gears.invites_count(feed, "event_type")))
    return rules.materialize("share", {"Event": _feed(spark, sf_dir)})


@_query(V + "select user_id, cast(sum(weight * cents) as bigint) as total from feed where change_seq > -5000 group by 1")
def gear_diff_fold(spark, sf_dir):
    """What a delta, retractions with it, adds to each user's sum."""
    return gears.diff_fold(_feed(spark, sf_dir).where("change_seq > -5000"), ["user_id"], F.col("cents"), "total")


@_query(V + "select event_type as bucket, cast(sum(cents * tx) as bigint) as total from winners group by 1")
def gear_mulsum_signed(spark, sf_dir):
    """Sum of products over a feed with retractions; equals that over the winners."""
    return gears.mulsum(_feed(spark, sf_dir).select(F.col("event_type").alias("bucket"), F.col("cents").alias("a"), F.col("tx").alias("b"), "weight"))


@_query(V + "select user_id as doc, event_type as branch, cast(sum(cents) as bigint) as total from winners group by 1, 2")
def gear_doc_counter_signed(spark, sf_dir):
    """Counters of documents and branches over a feed with retractions."""
    return gears.doc_counter(_feed(spark, sf_dir).select(F.col("user_id").alias("doc"), F.col("event_type").alias("branch"), F.col("cents").alias("delta"), "weight"))


@_query(V + "select user_id, cast(sum(cents) as bigint) as total from winners group by 1")
def view_linear(spark, sf_dir):
    """A sum kept over three epochs of the feed, each of which costs its own delta; equals the full sum."""
    view = streaming.LinearView(spark, _folder(spark, "linear"), ["user_id"], "cents", "total")
    feed = _feed(spark, sf_dir)
    for epoch in range(3):
        view.apply(feed.where(F.pmod("change_seq", F.lit(3)) == epoch), epoch)
    return view.current()


@_query("""select user_id, event_id, cast(sum(cents) over (partition by user_id order by event_id) as bigint) as running
from (select user_id, event_id, cast(round(value * 100) as bigint) as cents from events where event_id % 7 <> 0)""")
def view_retraction(spark, sf_dir):
    """An ordered fold's timeline, running sums, after an epoch that retracts events: they leave nothing behind."""

    def running(ctx: stategraph.Context, e: dict) -> None:
        ctx.update("sum", (ctx.query("sum") or 0) + e["cents"])

    view = streaming.FoldView(spark, _folder(spark, "fold"), running, ["user_id"], ["event_id"], "string", "bigint")
    rows = _versions(spark, sf_dir).select("user_id", "event_id", "cents")
    view.apply(rows.withColumn("weight", F.lit(1)), 0)
    view.apply(rows.where("event_id % 7 = 0").withColumn("weight", F.lit(-1)), 1)
    return view.timeline().select("user_id", "event_id", F.col("value").alias("running"))


@_query(V + """, s as (select user_id, event_id from winners where event_type = 'signup' and cents % 5 = 0), f as (select user_id, min(event_id) as first_id from s
group by 1) select r.event_id, r.user_id from winners r join f using (user_id) where r.event_type = 'view' and r.event_id >= first_id""")
def sg_changed_dependencies(spark, sf_dir):
    """The views that read a user's sign-ups at or after the first of them that changed."""
    t = _timeline(spark, sf_dir)
    old = t.where("event_type = 'signup'").select("user_id", "ord", "value")
    new = old.withColumn("value", F.when(F.col("value") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")))
    return stategraph.changed_dependencies(old, new, t.where("event_type = 'view'").select("event_id", "user_id", "ord"), ["user_id"]).select("event_id", "user_id")


@_query(V + "select user_id, event_id, 'update' as change, cents as old_value, cents + 1 as new_value from winners where event_type = 'click' and cents % 2 = 0")
def sg_effective_changes(spark, sf_dir):
    """What follows from an evaluation that wrote some equal values again and some others: only the others."""
    t = _timeline(spark, sf_dir)
    after = t.withColumn("value", F.when((F.col("event_type") == "click") & (F.col("value") % 2 == 0), F.col("value") + 1).otherwise(F.col("value")))
    return stategraph.effective_changes(t, after, ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"), "change", "old_value", "new_value")


@_query(V + """, t as (select *, last_value(case when event_type = 'purchase' then event_id end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as read_id
from winners where event_type in ('view', 'purchase')) select event_id, read_id from t where event_type = 'view'""")
def sg_read_sets(spark, sf_dir):
    """The purchase that every view read."""
    t = _timeline(spark, sf_dir)
    writes = t.where("event_type = 'purchase'").select("user_id", "ord", "value")
    return stategraph.read_sets(t.where("event_type = 'view'").select("event_id", "user_id", "ord"), writes, ["user_id"]).select("event_id", F.col("read_ord.event_id").alias("read_id"))


# --- timelines -------------------------------------------------------------------------------------------------


@_query(V + "select event_id, cents as value, cast(row_number() over (order by ts, event_id) as int) as place from winners where user_id = 1")
def timeline_history(spark, sf_dir):
    """One key's writes in order."""
    own = timeline.history(_timeline(spark, sf_dir), F.col("user_id") == 1)
    return own.select(F.col("ord.event_id").alias("event_id"), "value", F.row_number().over(Window.partitionBy("user_id").orderBy("ord")).alias("place"))


@_query(V + _TWO + " select a.user_id, a.event_id, a.value from a join b on a.event_id = b.event_id")
def timeline_get(spark, sf_dir):
    """The values of the older version at the positions of the newer."""
    old, new = _two(_timeline(spark, sf_dir))
    return timeline.get(old, new, ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"), "value")


@_query(V + _TWO + " select b.user_id, b.event_id from a join b on a.event_id = b.event_id")
def timeline_contains(spark, sf_dir):
    """The positions of the newer version that the older contains."""
    old, new = _two(_timeline(spark, sf_dir))
    return timeline.contains(old, new.select("user_id", "ord"), ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"))


@_query(V + "select user_id, event_id, -cents as value from winners")
def timeline_remap(spark, sf_dir):
    """All values turned by a function."""
    return timeline.remap(_timeline(spark, sf_dir), lambda v: -v).select("user_id", F.col("ord.event_id").alias("event_id"), "value")


@_query(V + _TWO + ", u as (select user_id, event_id from a union select user_id, event_id from b) select user_id, event_id from u")
def timeline_set(spark, sf_dir):
    """The set variant: positions of both versions, each once."""
    old, new = _two(_timeline(spark, sf_dir))
    return timeline.same_events(old.unionByName(new), ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"))


# --- vocabulary ------------------------------------------------------------------------------------------------


@_query("select event_id, event_type as kept, user_id as rest, event_id * 2 as other from events")
def record_fields(spark, sf_dir):
    """Fields kept, and fields left when one is dropped."""
    r = fn.record(tag=F.col("event_type"), user=F.col("user_id"), twice=F.col("event_id") * 2)
    e = _table(spark, sf_dir, "events").select("event_id", fn.record_keep(r, "tag").alias("a"), fn.record_drop(r, "tag").alias("b"))
    return e.select("event_id", F.col("a.tag").alias("kept"), F.col("b.user").alias("rest"), F.col("b.twice").alias("other"))


@_query("select event_id, event_type as kind, user_id as usr, null::bigint as amount, 'visit' as exact, 'purchase' as wide from events")
def record_registry(spark, sf_dir):
    """A record made from two of its fields is the first registered one that has them; the rest is null."""
    records = Records()
    records.register("mark", "kind string")
    records.register("purchase", "kind string, usr bigint, amount bigint")
    records.register("visit", "kind string, usr bigint")
    made = records.make(usr=F.col("user_id"), kind=F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", made.alias("r"), F.lit(records.exact("kind", "usr")).alias("exact"), F.lit(records.of("kind", "usr")).alias("wide")).select("event_id", "r.*", "exact", "wide")


@_query("""select user_id, sha256('{"v":"' || user_id || '"}') as hash, cast('0x' || substr(sha256('{"v":' || user_id || '}'), 1, 8) as bigint) as route, 'Total' as rule from (select distinct user_id from events)""")
def runtime_traits(spark, sf_dir):
    """What a rule says of itself, of its groups' places and of its data's hashes."""
    rule = Total()
    users = _table(spark, sf_dir, "events").select("user_id").distinct()
    return users.select("user_id", rule.hash_data(F.col("user_id").cast("string")).alias("hash"), rule.route_group(F.col("user_id")).alias("route"), F.lit(rule.meta()["name"]).alias("rule"))


@_query("select event_id, item from (select event_id, unnest([event_id, user_id, 7]) as item from events)")
def iter_list(spark, sf_dir):
    """The items of a list, one after the other."""
    return _table(spark, sf_dir, "events").select("event_id", fn.lookup("iter_list")(fn.list_of(F.col("event_id"), F.col("user_id"), F.lit(7).cast("bigint"))).alias("item"))


@_query("""select event_id, event_type = 'view' as same_tag, user_id = event_id % 10 as same_user, event_id as wrapped, user_id as usr, event_type as id, event_id as k, user_id as v, event_id + user_id as natural, true as unit, cast(5 as bigint) as five
from events""")
def small_functions(spark, sf_dir):
    """Equality of tags and users, identities, constructors of ids, pairs, unit, constants and sums of naturals."""
    e, p = F.col("event_id"), fn.pair(F.col("event_id"), F.col("user_id"))
    return _table(spark, sf_dir, "events").select(
        "event_id", fn.tag_eq(F.col("event_type"), "view").alias("same_tag"), fn.user_eq(fn.user_id(F.col("user_id")), e % 10).alias("same_user"), fn.unwrap(fn.wrap(e)).alias("wrapped"), fn.user_id(F.col("user_id").cast("int")).alias("usr"),
        fn.data_id(fn.identity(F.col("event_type"))).alias("id"), p["k"].alias("k"), p["v"].alias("v"), fn.natural_add(e, F.col("user_id")).alias("natural"), fn.unit()["unit"].alias("unit"), fn.int_add(2, 3).alias("five"),
    )


@_query("""select event_id, event_type = 'view' as has, case when event_type = 'view' then user_id end as body, case when event_type = 'view' then user_id else -1 end as value, case when event_type = 'view' then 1 else 0 end as fixed
from events""")
def option_record(spark, sf_dir):
    """Options as records, and what they hold or a default."""
    view = F.col("event_type") == "view"
    e = _table(spark, sf_dir, "events").withColumn("o", fn.some_if(view, F.col("user_id")))
    fixed = F.when(view, fn.opt_unwrap(fn.some(1), 2)).otherwise(fn.opt_unwrap(fn.none("int"), 0))
    return e.select("event_id", "o.has", "o.body", fn.opt_unwrap(F.col("o"), F.lit(-1).cast("bigint")).alias("value"), fixed.alias("fixed"))


@_query("select event_id, gcd(event_id, user_id) as divisor from events")
def loop_gcd(spark, sf_dir):
    """General recursion for every row: the greatest common divisor, whose number of rounds isn't known beforehand."""
    pair = F.struct(F.col("event_id").alias("a"), F.col("user_id").alias("b"))
    return _table(spark, sf_dir, "events").select("event_id", fn.loop_column(pair, lambda again, s: s["a"] if s["b"] == 0 else again({"a": s["b"], "b": s["a"] % s["b"]}), "bigint").alias("divisor"))


@_query("""select case width when 'I8+' then 255 when 'I8' then 127 when 'I16+' then 65535 when 'I16' then 32767 when 'I32+' then 4294967295 when 'I32' then 2147483647 else 9223372036854775807 end as most, width
from (select unnest(['I8', 'I8+', 'I16', 'I16+', 'I32', 'I32+', 'I64', 'I64+']) as width)""")
def widths(spark, sf_dir):
    """The greatest number of every fixed width, which passes its check."""
    most = {"I8": 127, "I8+": 255, "I16": 32767, "I16+": 65535, "I32": 2**31 - 1, "I32+": 2**32 - 1, "I64": 2**63 - 1, "I64+": 2**63 - 1}
    rows = spark.createDataFrame(list(most.items()), "width string, most bigint")
    passed = F.coalesce(*[F.when(F.col("width") == w, fn.in_width(F.when(F.col("width") == w, F.col("most")).otherwise(F.lit(0)), w)) for w in most])
    return rows.select("width", passed.alias("most"))


_NAMES = " ".join("""
if int_add int_mul int_neg int_== int_>=0 list_length list_indexl list_viewl tag_== w_wrap w_unwrap loop loop_iter iter_list record_get
record_keep_fields record_drop_fields mk_event_type mk_gear mk_query query_delta mk_stategraph stategraph_apply stategraph_out sgctx_query
sgctx_update sgctx_dep_query resolve_event resolve_data sender-to>user user_eq UserId DataId Id Gear Query EventTypeId LocEventId Timestamp
StateGraph StateGraphOut mk_anchor_agg anchor_agg_apply mk_text_agg text_agg_apply text_agg_merge secondary_get _+_ _-_ _*_ _>=_ _>_ _<=_
_<_ id _=>_ unit _++_ int-clamp>int+ mk_none mk_some mk_some_if opt_unwrap iter_<
""".split())


@_query("select unnest(string_split('" + _NAMES + "', ' ')) as name, true as found")
def vocabulary(spark, sf_dir):
    """Every name of the rule language leads to a function."""
    return spark.createDataFrame([(name, callable(fn.lookup(name))) for name in fn.names()], "name string, found boolean")


@_query("select event_id, user_id, event_type from events where event_type in ('view', 'click') and value > 100")
def handler_filter(spark, sf_dir):
    """A handler that writes only where its condition holds."""
    return _table(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click") & (F.col("value") > 100)).select("event_id", "user_id", "event_type")


__all__ = ["IDENTITY", "Total"]
