"""All queries over the test tables, with the SQL that each is held against.

``events`` is read as the raw log of versions: the sender and group is user_id, the type is event_type and the transaction is the number in
props, so some identities have several versions. Versions arrive newest first, so late ones rewrite history.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog import functions as fn
from tidelog.operators import gears, routing, stategraph, text, timeline
from tidelog.shared import written
from tidelog.sources import log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FLAGSHIP = "sg_invited"
IDENTITY, VERSION = ["user_id", "event_type", "tx"], ["ts", "event_id"]


def _query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select("user_id", "event_type", F.regexp_extract("props", "([0-9]+)", 1).cast("bigint").alias("tx"), "ts", "event_id", (F.round(F.col("value") * 100)).cast("bigint").alias("cents"), (-F.col("event_id")).alias("arrival"))


def _winners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.winners(_versions(spark, sf_dir), IDENTITY, VERSION)


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log.change_feed(_versions(spark, sf_dir), IDENTITY, VERSION, "arrival")


V = """with versions as (
  select user_id, event_type, cast(regexp_extract(props, '([0-9]+)', 1) as bigint) as tx, ts, event_id, cast(round(value * 100) as bigint) as cents, -event_id as arrival from events
), winners as (
  select * exclude (nth) from (select *, row_number() over (partition by user_id, event_type, tx order by ts, event_id) as nth from versions) where nth = 1
), seen as (
  select *, min(event_id) over w as least_id from versions window w as (partition by user_id, event_type, tx order by arrival rows between unbounded preceding and 1 preceding)
), fresh as (
  select s.*, o.event_id as old_id, o.ts as old_ts, o.cents as old_cents from seen s left join versions o on o.event_id = s.least_id where s.least_id is null or (s.ts, s.event_id) < (o.ts, o.event_id)
), feed as (
  select user_id, event_type, tx, ts, event_id, cents, arrival * 2 + 1 as change_seq, 1 as weight from fresh
  union all select user_id, event_type, tx, old_ts, old_id, old_cents, arrival * 2, -1 from fresh where old_id is not null
)
"""
# --- the log ---------------------------------------------------------------------------------------------------


@_query(V + "select user_id, event_type, tx, event_id from winners")
def log_dedup_winner(spark, sf_dir):
    """Earliest version of every identity."""
    return _winners(spark, sf_dir).select(*IDENTITY, "event_id")


@_query(V + "select user_id, event_type, tx, event_id, change_seq, weight from feed")
def log_change_feed(spark, sf_dir):
    """Signed changes of the winner set by arrival."""
    return _feed(spark, sf_dir).select(*IDENTITY, "event_id", "change_seq", "weight")


@_query("select event_id, user_id, ts from events where event_type = 'purchase'")
def group_scan(spark, sf_dir):
    """A rule's primary input; the type filter reaches the scan."""
    return _table(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts")


@_query(V + """, cur as (select user_id, max(change_seq) as cur from feed where event_type = 'signup' group by 1)
select f.user_id, event_type, tx, event_id, cast(sum(weight) as int) as weight from feed f left join cur using (user_id)
where change_seq > coalesce(cur, -1000000000000) group by all having sum(weight) <> 0""")
def query_delta_since(spark, sf_dir):
    """Net change of every group since its own cursor: the last sign-up that arrived."""
    feed = _feed(spark, sf_dir)
    cursors = feed.where("event_type = 'signup'").groupBy("user_id").agg(F.max("change_seq").alias("cursor"))
    return log.delta_since(feed.join(cursors, "user_id", "left"), F.coalesce("cursor", F.lit(-1000000000000)), [*IDENTITY, "event_id"])


@_query("select event_id, user_id, ts, n_name from events join nation on user_id % 25 = n_nationkey")
def event_lookup(spark, sf_dir):
    """Equi-join of events with a dimension."""
    e, n = _table(spark, sf_dir, "events"), _table(spark, sf_dir, "nation")
    return e.join(n, F.col("user_id") % 25 == F.col("n_nationkey")).select("event_id", "user_id", "ts", "n_name")


@_query("select o_orderkey, o_custkey, c_name from orders join customer on o_custkey = c_custkey")
def sender_to_user(spark, sf_dir):
    """The user behind every sender; a sender without one is an error."""
    senders = _table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    return log.resolve(_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), senders, F.col("o_custkey") == F.col("c_custkey"), required=log.UnknownSender).select("o_orderkey", "o_custkey", "c_name")


@_query("""select l_orderkey, l_linenumber, user_id as sender, cast(round(value * 100) as bigint) as body from lineitem
join events on event_id = (l_orderkey * 7 + l_linenumber) % (select count(*) from events)""")
def resolve_event(spark, sf_dir):
    """Sender and body of the event that every item refers to; one that isn't there is an error."""
    e = _table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("sender"), F.round(F.col("value") * 100).cast("bigint").alias("body"))
    n = e.count()
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", ((F.col("l_orderkey") * 7 + F.col("l_linenumber")) % n).alias("ref"))
    return log.resolve_event(items, e, "ref", "event_id").select("l_orderkey", "l_linenumber", "event.sender", "event.body")


@_query("select l_orderkey, l_linenumber, l_partkey, p_name from lineitem join part on l_partkey = p_partkey")
def resolve_data(spark, sf_dir):
    """Content of every data object that an item refers to; one that isn't there is an error."""
    parts = _table(spark, sf_dir, "part").select("p_partkey", "p_name")
    items = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return log.resolve(items, parts, F.col("l_partkey") == F.col("p_partkey"), required=log.UnknownData).select("l_orderkey", "l_linenumber", "l_partkey", "p_name")


@_query("select user_id, event_id from events e where user_id is not null and not exists (select 1 from supplier where s_suppkey = e.user_id)")
def validate_refs(spark, sf_dir):
    """Events whose sender isn't registered."""
    return log.unresolved(_table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", _table(spark, sf_dir, "supplier"), "s_suppkey")


@_query("select user_id, min_by(event_type, event_id) as event_type from events group by 1".replace("min_by", "arg_min"))
def first_binding(spark, sf_dir):
    """The first binding of every sender."""
    return log.first_binding(_table(spark, sf_dir, "events"), "user_id", "event_type", "event_id")


@_query("select distinct event_type, user_id from events")
def distinct_groups(spark, sf_dir):
    """All groups of the log."""
    return _table(spark, sf_dir, "events").select("event_type", "user_id").distinct()


@_query(V + "select user_id, event_type, tx, event_id from winners")
def replicated_log(spark, sf_dir):
    """Two nodes hold overlapping parts of the log; their union converges to the same winners."""
    v = _versions(spark, sf_dir)
    return log.winners(log.replicate(v.where("event_type <> 'view'"), v.where("event_type in ('view', 'click')")), IDENTITY, VERSION).select(*IDENTITY, "event_id")


# --- gears ----------------------------------------------------------------------------------------------------


@_query(V + "select user_id as branch, cast(count(*) as bigint) as invites from winners group by 1")
def gear_count(spark, sf_dir):
    """Signed count per branch; equals the count of winners."""
    return gears.invites_count(_feed(spark, sf_dir).withColumnRenamed("user_id", "branch"))


@_query("""select l_linenumber as bucket, cast(sum(cast(trunc(l_quantity) as bigint) * cast(round(l_discount * 100) as bigint)) as bigint) as total from lineitem
group by 1""")
def gear_mulsum(spark, sf_dir):
    """Sum of products per bucket."""
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("bucket"), F.col("l_quantity").cast("bigint").alias("a"), F.round(F.col("l_discount") * 100).cast("bigint").alias("b"), F.lit(1).alias("weight"))
    return gears.mulsum(items)


@_query("select l_partkey as doc, l_suppkey as branch, cast(sum(cast(trunc(l_quantity) as bigint)) as bigint) as total from lineitem group by 1, 2")
def gear_doc_counter(spark, sf_dir):
    """Counter per document and branch."""
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("doc"), F.col("l_suppkey").alias("branch"), F.col("l_quantity").cast("bigint").alias("delta"), F.lit(1).alias("weight"))
    return gears.doc_counter(items)


@_query(V + "select user_id, cast(sum(cents) as bigint) as total from winners group by 1")
def gear_incremental(spark, sf_dir):
    """A sum kept by applying a delta to an earlier result; equals the full sum."""
    feed = _feed(spark, sf_dir).withColumn("total", F.col("cents") * F.col("weight"))
    half = F.lit(-10000)
    before = feed.where(F.col("change_seq") <= half).groupBy("user_id").agg(F.sum("total").alias("total"))
    return gears.apply_linear(before, feed.where(F.col("change_seq") > half), ["user_id"], "total")


@_query(V + "select user_id, cast(sum(cents) as bigint) as total from winners group by 1")
def gear_full_fold(spark, sf_dir):
    """The same sum as an ordered fold over the winners."""
    w = _winners(spark, sf_dir).withColumn("ord", F.struct(*VERSION))
    return gears.full_fold(w, ["user_id"], F.lit(0).cast("bigint"), lambda acc, v: acc + v, F.col("cents"), "total")


# --- timelines -------------------------------------------------------------------------------------------------


def _timeline(spark, sf_dir) -> DataFrame:
    return _winners(spark, sf_dir).select("user_id", F.struct(*VERSION).alias("ord"), F.col("cents").alias("value"), "event_type", "event_id", "ts")


@_query(V + """select event_id, last_value(case when event_type = 'purchase' then cents end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as previous
from winners""")
def timeline_own_before(spark, sf_dir):
    """Every event with its user's last purchase strictly before it, as a fold reads its own state."""
    t = _timeline(spark, sf_dir).withColumn("value", F.when(F.col("event_type") == "purchase", F.col("value")))
    return timeline.own_before(t, ["user_id"]).select("event_id", "previous")


@_query(V + """select event_id, last_value(case when event_type = 'purchase' then cents end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as previous
from winners""")
def timeline_latest_before(spark, sf_dir):
    """Every event with its user's last purchase strictly before it, looked up in the timeline of purchases."""
    t = _timeline(spark, sf_dir)
    purchases = t.where("event_type = 'purchase'").select("user_id", "ord", "value")
    return timeline.latest_before(t.select("user_id", "ord", "event_id"), purchases, ["user_id"], into="previous").select("event_id", "previous")


@_query(V + """select event_id, last_value(case when event_type = 'purchase' then cents end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as latest
from winners where event_type in ('purchase', 'view') qualify event_type = 'view'""")
def timeline_latest_at(spark, sf_dir):
    """Every view with its user's last purchase at or before it."""
    t = _timeline(spark, sf_dir)
    views, purchases = t.where("event_type = 'view'").select("user_id", "ord", "event_id"), t.where("event_type = 'purchase'").select("user_id", "ord", "value")
    return timeline.latest_at(views, purchases, ["user_id"]).select("event_id", "latest")


@_query(V + "select event_id, lead(event_id) over (partition by user_id order by ts, event_id) as next_id from winners")
def timeline_next_after(spark, sf_dir):
    """Every event with the next of its user."""
    return timeline.next_after(_timeline(spark, sf_dir), ["user_id"]).select("event_id", F.col("next_ord.event_id").alias("next_id"))


@_query(V + """select user_id, min(event_id) as first_id, max(event_id) as last_id, arg_min(cents, event_id) as first_value, arg_max(cents, event_id) as last_value
from winners group by 1""")
def timeline_first_last(spark, sf_dir):
    """First and current value of every key (order by ts is order by event_id here)."""
    t = _timeline(spark, sf_dir)
    a, b = timeline.first(t, ["user_id"]), timeline.last(t, ["user_id"])
    return a.select("user_id", F.col("ord.event_id").alias("first_id"), F.col("value").alias("first_value")).join(b.select("user_id", F.col("ord.event_id").alias("last_id"), F.col("value").alias("last_value")), "user_id")


_BOUNDS = ", bounds as (select user_id, min(event_id) as low, max(event_id) as high from winners where event_type = 'signup' group by 1)"


def _bounds(t: DataFrame) -> DataFrame:
    return t.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ord").alias("low"), F.max("ord").alias("high"))


@_query(V + _BOUNDS + " select user_id, event_id from winners join bounds using (user_id) where event_id > low and event_id <= high")
def timeline_range_between(spark, sf_dir):
    """Writes after a user's first sign-up up to and including the last."""
    t = _timeline(spark, sf_dir)
    return timeline.range_between(_bounds(t), t, ["user_id"], "low", "high").select("user_id", "event_id")


@_query(V + _BOUNDS + " select user_id, event_id from winners join bounds using (user_id) where event_id > high")
def timeline_range_after(spark, sf_dir):
    """Writes after a user's last sign-up."""
    t = _timeline(spark, sf_dir)
    return timeline.range_between(_bounds(t), t, ["user_id"], "high", None).select("user_id", "event_id")


@_query(V + "select user_id, count(*) as size from winners group by 1")
def timeline_sizes(spark, sf_dir):
    """Length of every timeline."""
    return timeline.sizes(_timeline(spark, sf_dir), ["user_id"])


_TWO = """, a as (select user_id, event_id, cents as value from winners
where event_type <> 'error'), b as (select user_id, event_id, case when event_type = 'click' then cents + 1 else cents end as value from winners
where event_type <> 'view')"""


def _two(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    old = t.where("event_type <> 'error'").select("user_id", "ord", "value")
    return old, t.where("event_type <> 'view'").select("user_id", "ord", F.when(F.col("event_type") == "click", F.col("value") + 1).otherwise(F.col("value")).alias("value"))


@_query(V + _TWO + """
select coalesce(a.user_id, b.user_id) as user_id, coalesce(a.event_id, b.event_id) as event_id, case when a.event_id is null then 'add' when b.event_id is null then 'remove' else 'update' end as change, a.value as old_value, b.value as new_value
from a full join b on a.user_id = b.user_id and a.event_id = b.event_id where a.value is distinct
from b.value or a.event_id is null or b.event_id is null""")
def timeline_diff(spark, sf_dir):
    """Differences of two versions of all timelines."""
    return timeline.diff(*_two(_timeline(spark, sf_dir)), ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"), "change", "old_value", "new_value")


@_query(V + _TWO + " select user_id, event_id, value from b")
def timeline_apply_delta(spark, sf_dir):
    """The older version after the differences is the newer."""
    old, new = _two(_timeline(spark, sf_dir))
    return timeline.apply_diff(old, timeline.diff(old, new, ["user_id"]), ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"), "value")


@_query(V + _TWO + """, k as (select user_id from a union select user_id from b), d as (select distinct user_id from (select * from a except select * from b
union all (select * from b except select * from a))) select user_id, case when user_id not in (select user_id
from a) then 'added' when user_id not in (select user_id from b) then 'removed' else 'changed' end as change from d""")
def timeline_key_diff(spark, sf_dir):
    """Keys whose timelines differ."""
    return timeline.key_diff(*_two(_timeline(spark, sf_dir)), ["user_id"])


@_query(V + _TWO + " select user_id, event_id, value from a where not exists (select 1 from b where b.event_id = a.event_id)")
def timeline_remove(spark, sf_dir):
    """The older version without the positions of the newer."""
    old, new = _two(_timeline(spark, sf_dir))
    return timeline.remove(old, new, ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"), "value")


@_query(V + _TWO + """ select user_id, event_id, value from b union all select user_id, event_id, value from a where not exists (select 1 from b
where b.event_id = a.event_id)""")
def timeline_insert(spark, sf_dir):
    """The older version with the newer one's writes in it."""
    old, new = _two(_timeline(spark, sf_dir))
    return timeline.insert(old, new, ["user_id"]).select("user_id", F.col("ord.event_id").alias("event_id"), "value")


# --- folds -----------------------------------------------------------------------------------------------------


@_query(V + """, t as (select *, last_value(case when event_type = 'signup' then cents end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as dep
from winners where event_type in ('signup', 'purchase')) select event_id, user_id, dep from t where event_type = 'purchase' and dep % 2 = 0""")
def sg_dep_filter(spark, sf_dir):
    """Purchases whose user's last sign-up at that point has an even value."""
    t = _timeline(spark, sf_dir)
    dep = t.where("event_type = 'signup'").select("user_id", "ord", "value")
    return stategraph.depend(t.where("event_type = 'purchase'").select("user_id", "ord", "event_id"), dep, ["user_id"]).where("dep % 2 = 0").select("event_id", "user_id", "dep")


@_query(V + """, w as (select user_id, event_id, cents, lead(event_id) over (partition by user_id order by ts, event_id) as nxt from winners
where event_type = 'signup') select distinct r.event_id, r.user_id from winners r
join w on r.user_id = w.user_id and r.event_id > w.event_id and (w.nxt is null or r.event_id <= w.nxt) where r.event_type = 'view' and w.cents % 3 = 0""")
def sg_bounded_replay(spark, sf_dir):
    """The views that a change of some sign-ups reaches: up to the next sign-up."""
    t = _timeline(spark, sf_dir)
    writes = t.where("event_type = 'signup'").select("user_id", "ord", "value")
    return stategraph.affected_readers(t.where("event_type = 'view'").select("user_id", "ord", "event_id"), writes, writes.where("value % 3 = 0"), ["user_id"]).select("event_id", "user_id")


def _zero():
    return F.lit(0).cast("bigint")


def _root_edit(column: str):
    """An edit that adds one anchor under the root, with the column's text."""
    anchor = F.struct(F.lit(None).cast(text.ANCHOR).alias("parent"), F.lit(0).alias("offset"))
    return F.struct(F.array(anchor).alias("new_anchors"), F.array(column).alias("new_strings"), F.array().cast(f"array<{text.ANCHOR}>").alias("deletions")).cast(text.TEXT_UPDATE)


def _users(spark, sf_dir) -> int:
    return _table(spark, sf_dir, "events").agg(F.max("user_id")).first()[0] + 1


def _invites(spark, sf_dir) -> DataFrame:
    """Every event is an invitation by its user; user 0 made all branches."""
    e, zero = _table(spark, sf_dir, "events"), F.lit(0).cast("bigint")
    return e.select(
        F.col("event_type").alias("branch"), zero.alias("creator"), F.col("user_id").alias("user"),
        (F.col("event_id") * 7 % _users(spark, sf_dir)).alias("invitee"), F.col("event_id").alias("ts"), zero.alias("route_id"), zero.alias("tx_id"), F.lit("").alias("sender"),
    )


_MEMBERS = """recursive steps as (
  select event_type as branch, user_id as usr, event_id * 7 % (select max(user_id) + 1 from events) as invitee, event_id, row_number() over (partition by event_type order by event_id) as nth from events
), fold(branch, nth, members, wrote, event_id) as (
  select distinct event_type, cast(0 as bigint), [cast(0 as bigint)], cast(null as bigint), cast(null as bigint) from events
  union all
  select f.branch, s.nth, case when list_contains(f.members, s.usr) and not list_contains(f.members, s.invitee) then list_append(f.members, s.invitee) else f.members end,
         case when list_contains(f.members, s.usr) then s.invitee end, s.event_id
  from fold f join steps s on s.branch = f.branch and s.nth = f.nth + 1
)"""


@_query(f"with {_MEMBERS} select branch, wrote as member, cast(min(event_id) as bigint) as since, count(*) as writes from fold where wrote is not null group by 1, 2")
def sg_invited(spark, sf_dir):
    """Membership of every branch: since when, and how many invitations confirm it."""
    folded = gears.invited(_invites(spark, sf_dir))
    return folded.groupBy("branch", F.col("key").alias("member")).agg(F.min("ts").alias("since"), F.count("*").alias("writes"))


@_query("""with recursive n as (select max(user_id) + 1 as n from events), steps as (
  select event_type as site, case when user_id % 50 = 0 then null else user_id end as admin, event_id % (select n from n) as target, ['None', 'User', 'Moderator', 'Admin'][cast(event_id // 20 % 4 as int) + 1] as lvl, event_id,
         row_number() over (partition by event_type order by event_id) as nth from events
), fold(site, nth, levels, wrote, lvl, event_id) as (
  select distinct event_type, cast(0 as bigint), list_transform(range((select n from n)), lambda x: 'unset'), cast(null as bigint), cast(null as varchar), cast(null as bigint) from events
  union all
  select f.site, s.nth, case when s.admin is null or f.levels[s.admin + 1] = 'Admin' then list_concat(f.levels[:s.target], [s.lvl], f.levels[s.target + 2:]) else f.levels end,
         case when s.admin is null or f.levels[s.admin + 1] = 'Admin' then s.target end, s.lvl, s.event_id
  from fold f join steps s on s.site = f.site and s.nth = f.nth + 1
)
select site, wrote as target, event_id as event, lvl as level from fold where wrote is not null""")
def sg_rbac(spark, sf_dir):
    """Access levels of every site: all accepted changes."""
    e, n = _table(spark, sf_dir, "events"), _users(spark, sf_dir)
    level = F.element_at(F.array(*map(F.lit, gears.LEVELS)), (F.floor(F.col("event_id") / 20) % 4).cast("int") + 1)
    changes = e.select(F.col("event_type").alias("site"), F.when(F.col("user_id") % 50 != 0, F.col("user_id")).alias("admin"), (F.col("event_id") % n).alias("target"), level.alias("level"), F.col("event_id").alias("event"))
    return gears.access_levels(changes).select("site", F.col("key").alias("target"), "event", F.col("value").alias("level"))


@_query(f"with {_MEMBERS} select branch, wrote as member, event_id as ts from fold where wrote is not null")
def oneshot_equals_multishot(spark, sf_dir):
    """All membership writes after folding half of the events and replaying from the earliest change once the rest came."""
    invites = _invites(spark, sf_dir)

    def handler(ctx: stategraph.Context, e: dict) -> None:
        member = ctx.query(e["user"])
        if member if member is not None else e["user"] == e["creator"]:
            ctx.update(e["invitee"], True)

    before = gears.invited(invites.where("ts % 2 = 0"))
    since = invites.where("ts % 2 <> 0").groupBy("branch").agg(F.min(F.struct(*gears.ORDER)).alias("since_ord"))
    twice = stategraph.replay(invites, before, since, handler, ["branch"], gears.ORDER, "bigint", "boolean")
    return twice.select("branch", F.col("key").alias("member"), "ts")


# --- functions -------------------------------------------------------------------------------------------------

_L = "with l as (select user_id, list(cast(round(value * 100) as bigint) order by event_id) as xs from events group by 1) "


def _lists(spark, sf_dir) -> DataFrame:
    e = _table(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.round(F.col("value") * 100).cast("bigint").alias("v")).alias("s"))
    return e.groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["v"]).alias("xs"))


@_query(_L + "select user_id, cast(len(xs) as bigint) as n from l")
def list_length(spark, sf_dir):
    return _lists(spark, sf_dir).select("user_id", fn.list_length(F.col("xs")).alias("n"))


@_query(_L + "select user_id, xs[1] as head, xs[len(xs)] as tail from l")
def list_index(spark, sf_dir):
    xs = F.col("xs")
    return _lists(spark, sf_dir).select("user_id", fn.list_index(xs, 0).alias("head"), fn.list_index(xs, F.size(xs) - 1).alias("tail"))


@_query(_L + "select user_id, xs[1] as head, cast(len(xs) - 1 as int) as rest, coalesce(list_sum(xs[2:]), 0)::bigint as rest_sum from l")
def list_view(spark, sf_dir):
    v = _lists(spark, sf_dir).withColumn("v", fn.list_view(F.col("xs")))
    return v.select("user_id", F.col("v.left").alias("head"), F.size("v.rest").alias("rest"), fn.fold_left(F.col("v.rest"), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("rest_sum"))


@_query(_L + "select user_id, list_reduce(list_prepend(cast(1 as bigint), xs), lambda a, x: (a * 31 + x) % 1000003) as folded from l")
def fold_left(spark, sf_dir):
    return _lists(spark, sf_dir).select("user_id", fn.fold_left(F.col("xs"), F.lit(1).cast("bigint"), lambda a, x: (a * 31 + x) % 1000003).alias("folded"))


@_query(_L + "select user_id, list_reduce(list_prepend(cast(1 as bigint), list_reverse(xs)), lambda a, x: (a * 31 + x) % 1000003) as folded from l")
def fold_right(spark, sf_dir):
    return _lists(spark, sf_dir).select("user_id", fn.fold_right(F.col("xs"), F.lit(1).cast("bigint"), lambda x, a: (a * 31 + x) % 1000003).alias("folded"))


@_query("""select event_id, event_id + user_id as added, event_id * user_id as times, -event_id as negated, event_id - user_id as less, event_id = user_id as same, event_id - user_id >= 0 as natural
from events""")
def int_ops(spark, sf_dir):
    a, b = F.col("event_id"), F.col("user_id")
    return _table(spark, sf_dir, "events").select("event_id", fn.int_add(a, b).alias("added"), fn.int_mul(a, b).alias("times"), fn.int_neg(a).alias("negated"), fn.int_sub(a, b).alias("less"), fn.int_eq(a, b).alias("same"), fn.is_natural(fn.int_sub(a, b)).alias("natural"))


@_query("select event_id, event_id >= user_id as ge, event_id > user_id as gt, event_id <= user_id as le, event_id < user_id as lt from events")
def cmp_ops(spark, sf_dir):
    a, b = F.col("event_id"), F.col("user_id")
    return _table(spark, sf_dir, "events").select("event_id", fn.ge(a, b).alias("ge"), fn.gt(a, b).alias("gt"), fn.le(a, b).alias("le"), fn.lt(a, b).alias("lt"))


@_query("select event_id, greatest(user_id - 75, 0) as clamped, user_id % 100 as narrow from events")
def clamp(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", fn.clamp_natural(F.col("user_id") - 75).alias("clamped"), fn.in_width(F.col("user_id") % 100, "I8").alias("narrow"))


@_query("select event_id, coalesce(case when event_type = 'view' then user_id end, -1) as value, case when event_type = 'click' then 1 else 0 end as picked from events")
def option_unwrap(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", fn.opt_unwrap(fn.some_if(F.col("event_type") == "view", F.col("user_id")), F.lit(-1).cast("bigint")).alias("value"), fn.if_else(F.col("event_type") == "click", 1, 0).alias("picked"))


@_query("select event_id, user_id as got, event_type as tag from events")
def record_get(spark, sf_dir):
    r = fn.record(user=F.col("user_id"), tag=F.col("event_type"))
    return _table(spark, sf_dir, "events").select("event_id", r.alias("r")).select("event_id", fn.record_get(F.col("r"), "user").alias("got"), fn.record_get(F.col("r"), "tag").alias("tag"))


@_query("select event_id, user_id as x, event_type as y, event_id * 2 as z from events")
def record_concat(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("event_id", fn.record(x=F.col("user_id"), y=F.col("event_type")).alias("a"), fn.record(x=F.lit(-1), z=F.col("event_id") * 2).alias("b"))
    return e.withColumn("c", fn.record_concat(F.col("a"), ["x", "y"], F.col("b"), ["x", "z"])).select("event_id", "c.x", "c.y", "c.z")


@_query("select user_id, cast(list_sum(range(user_id)) as bigint) as total from (select distinct user_id from events where user_id > 0)")
def count_up(spark, sf_dir):
    users = _table(spark, sf_dir, "events").where("user_id > 0").select("user_id").distinct()
    return users.select("user_id", fn.loop_times(F.col("user_id"), F.lit(0).cast("bigint"), lambda acc, i: acc + i).alias("total"))


@_query("select doc_id, text[3:7] as part from documents")
def char_slice(spark, sf_dir):
    """Characters 2 to 7 of every text, counted in Unicode scalars."""
    return _table(spark, sf_dir, "documents").select("doc_id", fn.char_slice(F.col("text"), 2, 7).alias("part"))


# --- text ------------------------------------------------------------------------------------------------------


def _edits(spark, sf_dir) -> DataFrame:
    """Every turn of a conversation is an anchor under the root; the last one of each deletes the first."""
    c = _table(spark, sf_dir, "conversations")
    anchor = F.struct(F.lit(None).cast(text.ANCHOR).alias("parent"), (F.col("turn") % 3).cast("int").alias("offset"))
    first = F.struct(F.lit(0).cast("bigint").alias("tx_id"), F.lit(0).cast("bigint").alias("route_id"), F.lit(0).alias("idx"), F.lit("user").alias("sender")).cast(text.ANCHOR)
    edit = F.struct(F.array(anchor).alias("new_anchors"), F.array("text").alias("new_strings"), F.when(F.col("turn") == 3, F.array(first)).otherwise(F.array().cast(f"array<{text.ANCHOR}>")).alias("deletions"))
    return c.select(F.col("conv_id").alias("doc"), F.lit(0).alias("branch"), F.col("turn").alias("tx_id"), F.lit(0).cast("bigint").alias("route_id"), F.col("role").alias("sender"), F.struct("turn", "role").alias("ord"), edit.alias("edit"))


_EDITED = """with edits as (select conv_id as doc, turn, role, text, turn % 3 as off from conversations), texts as (select doc, turn, role, off, text from edits e
where text <> '' and not (turn = 0 and role = 'user' and exists (select 1 from edits d where d.doc = e.doc and d.turn = 3))) """


@_query(_EDITED + "select doc, turn, role, cast(row_number() over (partition by doc order by off, turn desc, role) as int) as place from edits")
def text_anchor_order(spark, sf_dir):
    """The place of every anchor among its siblings."""
    from pyspark.sql import Window

    tree = text.anchors(_edits(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(*text.sibling_order()))
    return tree.select("doc", F.col("anchor.tx_id").alias("turn"), F.col("anchor.sender").alias("role"), place.alias("place"))


@_query(_EDITED + "select doc, turn, role, text from texts")
def text_apply(spark, sf_dir):
    """The strings that are in each document after all edits."""
    return text.apply_texts(_edits(spark, sf_dir)).select("doc", F.col("anchor.tx_id").alias("turn"), F.col("anchor.sender").alias("role"), "text")


@_query(_EDITED + """, a as (select * from texts where turn % 2 = 0), b as (select doc, turn, role, '~' || text as text from texts where turn % 3 = 0)
select coalesce(a.doc, b.doc) as doc, coalesce(a.turn, b.turn) as turn, coalesce(a.role, b.role) as role, coalesce(b.text, a.text) as text from a
full join b on a.doc = b.doc and a.turn = b.turn and a.role = b.role""")
def text_merge(spark, sf_dir):
    """Two branches of every document merged; the right one's text wins."""
    t = text.apply_texts(_edits(spark, sf_dir)).select("doc", F.col("anchor.tx_id").alias("turn"), F.col("anchor.sender").alias("role"), "text")
    return text.merge(t.where("turn % 2 = 0"), t.where("turn % 3 = 0").withColumn("text", F.concat(F.lit("~"), "text")), ["doc", "turn", "role"])


@_query(_EDITED + "select doc, string_agg(text, '' order by off, turn desc, role) as text from texts group by doc")
def text_render(spark, sf_dir):
    """Every document as it reads."""
    edits = _edits(spark, sf_dir)
    return text.render(text.anchors(edits), text.apply_texts(edits)).select("doc", "text")


@_query(_EDITED + "select doc, cast(row_number() over (partition by doc order by off, turn desc, role) - 1 as int) as position, turn, text from texts")
def text_segments(spark, sf_dir):
    """The pieces of every document in reading order."""
    edits = _edits(spark, sf_dir)
    return text.render_segments(text.anchors(edits), text.apply_texts(edits)).select("doc", "position", F.col("anchor.tx_id").alias("turn"), "text")


@_query("select item_id, replace(text, 'e', '') || '.' as text from benchmark")
def text_diff_roundtrip(spark, sf_dir):
    """Every item edited into another text by a diff, applied and rendered; the result is that text."""
    b = _table(spark, sf_dir, "benchmark").withColumn("target", F.concat(F.regexp_replace("text", "e", ""), F.lit(".")))
    edit = b.select("item_id", "text", text.diff_column(F.col("text"), F.col("target")).alias("edit"))
    none = F.array().cast(f"array<{text.ANCHOR}>")
    whole = F.struct(F.array(F.struct(F.lit(None).cast(text.ANCHOR).alias("parent"), F.lit(0).alias("offset"))).alias("new_anchors"), F.array("text").alias("new_strings"), none.alias("deletions")).cast(text.TEXT_UPDATE)
    side = lambda tx, e: edit.select(F.col("item_id").alias("doc"), F.lit(0).alias("branch"), F.lit(tx).cast("bigint").alias("tx_id"), F.lit(0).cast("bigint").alias("route_id"), F.lit("").alias("sender"), F.lit(tx).alias("ord"), e.alias("edit"))
    edits = side(0, whole).unionByName(side(1, F.col("edit").cast(text.TEXT_UPDATE)))
    return text.render(text.anchors(edits), text.apply_texts(edits)).select(F.col("doc").alias("item_id"), "text")


@_query(f"""with {_MEMBERS}, member as (
  select s.branch, m as usr, min(s.event_id) as since from fold f join steps s on s.branch = f.branch and s.nth = f.nth, unnest(f.members) as t(m) group by 1, 2
), att as (select conv_id as doc, (['view', 'click', 'error', 'purchase', 'signup'])[cast(conv_id % 5 as int) + 1] as branch, turn, role, text, conv_id * 7 % (select max(user_id) + 1 from events) as usr, conv_id * 50 + turn as pos from conversations)
select a.doc, a.branch, string_agg(a.text, '' order by a.turn desc, a.role) as text from att a left join member m on m.branch = a.branch and m.usr = a.usr
where a.usr = 0 or m.since <= a.pos group by 1, 2""")
def doc_content(spark, sf_dir):
    """Every document's text, of the authors who are members of its branch when they write."""
    members = gears.invited(_invites(spark, sf_dir))
    c = _table(spark, sf_dir, "conversations")
    branch = F.element_at(F.array(*map(F.lit, ("view", "click", "error", "purchase", "signup"))), (F.col("conv_id") % 5).cast("int") + 1)
    attaches = c.select(
        F.col("conv_id").alias("doc"), branch.alias("branch"), _zero().alias("creator"), (F.col("conv_id") * 7 % _users(spark, sf_dir)).alias("user"), F.lit(False).alias("is_merge"),
        _root_edit("text").alias("edit"), F.lit(None).cast("string").alias("from_branch"), (F.col("conv_id") * 50 + F.col("turn")).alias("ts"), _zero().alias("route_id"),
        F.col("turn").alias("tx_id"), F.col("role").alias("sender"),
    )
    return gears.doc_content(attaches, members)[1].where("text <> ''")


@_query("""with c as (select conv_id as doc, turn, role, text from conversations where text <> ''), a as (
  select doc, 'main' as branch, turn, role, text from c where turn % 2 = 0
  union all select doc, 'main', turn, role, text from c where turn % 2 = 1 and turn < 4
  union all select doc, 'side', turn, role, text from c where turn % 2 = 1)
select doc, branch, string_agg(text, '' order by turn desc, role) as text from a group by 1, 2""")
def doc_content_merge(spark, sf_dir):
    """Two branches of every document; the side branch is merged into the main one before turn 4, so its later turns aren't in it."""
    c = _table(spark, sf_dir, "conversations")
    side = F.when(F.col("turn") % 2 == 0, "main").otherwise("side")

    def own(rows, branch, merge, edit, source, ts, tx, sender):
        return rows.select(
            F.col("conv_id").alias("doc"), branch.alias("branch"), _zero().alias("creator"), _zero().alias("user"), F.lit(merge).alias("is_merge"), edit.alias("edit"),
            source.cast("string").alias("from_branch"), ts.cast("bigint").alias("ts"), _zero().alias("route_id"), tx.cast("bigint").alias("tx_id"), sender.alias("sender"),
        )

    edits = own(c, side, False, _root_edit("text"), F.lit(None), F.col("turn") * 2, F.col("turn"), F.col("role"))
    merges = own(c.select("conv_id").distinct(), F.lit("main"), True, F.lit(None).cast(text.TEXT_UPDATE), F.lit("side"), F.lit(7), F.lit(1000), F.lit("user"))
    nobody = gears.invited(_invites(spark, sf_dir).limit(0))
    return gears.doc_content(edits.unionByName(merges), nobody)[1].where("text <> ''")


def _nested(spark, sf_dir) -> DataFrame:
    """Every turn of a conversation is an anchor inside the turn before; turn 3 deletes turn 1, whose children stay."""
    from pyspark.sql import Window

    before = Window.partitionBy("conv_id").orderBy("turn")
    c = _table(spark, sf_dir, "conversations").withColumns({"up": F.lag("turn").over(before), "up_role": F.lag("role").over(before), "far": F.lag("turn", 2).over(before), "far_role": F.lag("role", 2).over(before)})
    anchor = lambda tx, role: F.struct(tx.alias("tx_id"), _zero().alias("route_id"), F.lit(0).alias("idx"), role.alias("sender")).cast(text.ANCHOR)
    parent = F.when(F.col("up").isNotNull(), anchor(F.col("up"), F.col("up_role")))
    gone = F.when((F.col("turn") == 3) & F.col("far").isNotNull(), F.array(anchor(F.col("far"), F.col("far_role")))).otherwise(F.array().cast(f"array<{text.ANCHOR}>"))
    edit = F.struct(F.array(F.struct(parent.alias("parent"), (F.col("turn") * 7 % 23).cast("int").alias("offset"))).alias("new_anchors"), F.array("text").alias("new_strings"), gone.alias("deletions")).cast(text.TEXT_UPDATE)
    return c.select(F.col("conv_id").alias("doc"), F.lit(0).alias("branch"), F.col("turn").alias("tx_id"), _zero().alias("route_id"), F.col("role").alias("sender"), F.struct("turn", "role").alias("ord"), edit.alias("edit"))


_NESTED = """with recursive c as (
  select conv_id as doc, turn, role, row_number() over (partition by conv_id order by turn) as nth, turn * 7 % 23 as off,
         case when lead(turn, 2) over (partition by conv_id order by turn) = 3 then '' else text end as body, count(*) over (partition by conv_id) as n from conversations
), r(doc, nth, off, txt, pieces) as (
  select doc, nth, off, body, case when body = '' then 0 else 1 end from c where nth = n
  union all
  select c.doc, c.nth, c.off, substr(c.body, 1, r.off) || r.txt || substr(c.body, r.off + 1), r.pieces + case when c.body = '' then 0 when r.off = 0 or r.off >= length(c.body) then 1 else 2 end
  from r join c on c.doc = r.doc and c.nth = r.nth - 1
)
"""


@_query(_NESTED + "select doc, txt as text from r where nth = 1")
def text_nested_render(spark, sf_dir):
    """Documents of nested anchors: each turn splits the text of the turn before, and a deleted one keeps what is in it."""
    edits = _nested(spark, sf_dir)
    return text.render(text.anchors(edits), text.apply_texts(edits)).select("doc", "text")


@_query(_NESTED + "select doc, cast(pieces as bigint) as pieces, length(txt) as chars from r where nth = 1")
def text_nested_segments(spark, sf_dir):
    """How many pieces every nested document is read in, and its length."""
    edits = _nested(spark, sf_dir)
    return text.render_segments(text.anchors(edits), text.apply_texts(edits)).groupBy("doc").agg(F.count("*").alias("pieces"), F.sum(F.length("text")).alias("chars"))


@_query("""select doc, turn, place
from (select conv_id as doc, turn, cast(row_number() over (partition by conv_id order by turn % 3, turn desc, role) as int) as place
from conversations) where place <= 2""")
def text_children(spark, sf_dir):
    """The first two children of every document's root."""
    from pyspark.sql import Window

    tree = text.anchors(_edits(spark, sf_dir))
    below = text.children(tree, "doc", F.lit(None).cast(text.ANCHOR))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(*text.sibling_order()))
    return below.withColumn("place", place).where("place <= 2").select("doc", F.col("anchor.tx_id").alias("turn"), "place")


@_query("select conv_id as doc, count(*) as parents from conversations group by 1")
def text_parents(spark, sf_dir):
    """How many anchors of every nested document have children, the root included."""
    return text.parents(text.anchors(_nested(spark, sf_dir)))


@_query("select cast(0 as bigint) as anchors, cast(0 as bigint) as texts, cast(count(distinct conv_id) as bigint) as edited from conversations")
def text_new_aggregates(spark, sf_dir):
    """New aggregates are empty; one edit of each document makes them not so."""
    edits = _edits(spark, sf_dir)
    none = edits.where(F.lit(False))
    of = {"anchors": text.anchors(none), "texts": text.apply_texts(none), "edited": text.anchors(edits.where("tx_id = 0"))}
    every = None
    for name, df in of.items():
        own = df.select(F.lit(name).alias("what"))
        every = own if every is None else every.unionByName(own)
    return every.agg(*[F.count_if(F.col("what") == name).alias(name) for name in of])


@_query(_EDITED + "select doc, turn, role, text, case when turn % 2 = 0 then text || '!' else text end as forked from texts")
def text_fork(spark, sf_dir):
    """A fork with edits of its own beside the branch that it came from, which stays as it was."""
    t = text.apply_texts(_edits(spark, sf_dir)).select("doc", F.col("anchor.tx_id").alias("turn"), F.col("anchor.sender").alias("role"), "text")
    fork = text.merge(t, t.where("turn % 2 = 0").withColumn("text", F.concat("text", F.lit("!"))), ["doc", "turn", "role"]).withColumnRenamed("text", "forked")
    return t.join(fork, ["doc", "turn", "role"])


@_query(_EDITED + "select doc, turn, role from edits e where not exists (select 1 from texts t where t.doc = e.doc and t.turn = e.turn and t.role = e.role)")
def text_deleted(spark, sf_dir):
    """The anchors of every document that have no text."""
    edits = _edits(spark, sf_dir)
    return text.is_deleted(text.anchors(edits), text.apply_texts(edits), ["doc", "anchor"]).select("doc", F.col("anchor.tx_id").alias("turn"), F.col("anchor.sender").alias("role"))


@_query("select conv_id as doc, turn, role, turn % 4 <> 0 and turn % 5 <> 1 as valid, cast(1 + case when turn = 3 then 1 else 0 end as int) as size from conversations")
def text_updates(spark, sf_dir):
    """Which updates are well formed, strings parallel to anchors and no offset negative, and how many anchors each adds and deletes."""
    edits = _edits(spark, sf_dir)
    more = F.when(F.col("tx_id") % 4 == 0, F.concat("edit.new_strings", F.array(F.lit("x")))).otherwise(F.col("edit.new_strings"))
    moved = F.transform("edit.new_anchors", lambda a: a.withField("offset", F.when(F.col("tx_id") % 5 == 1, -1).otherwise(a["offset"])))
    made = edits.withColumn("e", F.struct(moved.alias("new_anchors"), more.alias("new_strings"), F.col("edit.deletions").alias("deletions")))
    return made.select("doc", F.col("tx_id").alias("turn"), F.col("sender").alias("role"), text.valid_update(F.col("e")).alias("valid"), (F.size("e.new_anchors") + F.size("e.deletions")).alias("size"))


@_query(_EDITED + """, d as (select doc, string_agg(text, '' order by off, turn desc, role) as text from texts group by doc)
select doc, replace(text, 'en', 'EN+') as text, cast(0 as bigint) as untouched from d""")
def text_diff_multi_anchor(spark, sf_dir):
    """Documents of several anchors edited by a diff into another text, rendered; and how many anchors without the edited letters the diff deletes."""
    edits = _edits(spark, sf_dir)
    tree, texts = text.anchors(edits), text.apply_texts(edits)
    now = text.render(tree, texts).select("doc", F.regexp_replace("text", "en", "EN+").alias("target"))
    made = written(text.diff_documents(tree, texts.select("doc", "anchor", "text"), now), "diffs")  # read four times
    gone = made.select("doc", F.explode("edit.deletions").alias("anchor")).join(texts, ["doc", "anchor"]).where(~F.col("text").contains("e") & ~F.col("text").contains("n"))
    step = made.select("doc", F.lit(0).alias("branch"), F.lit(1 << 40).alias("tx_id"), _zero().alias("route_id"), F.lit("z").alias("sender"), F.struct(F.lit(1 << 40).alias("turn"), F.lit("z").alias("role")).alias("ord"), "edit")
    every = edits.withColumn("edit", F.col("edit").cast(text.TEXT_UPDATE)).unionByName(step)
    out = text.render(text.anchors(every), text.apply_texts(every)).select("doc", "text")
    return out.join(gone.groupBy("doc").agg(F.count("*").alias("n")), "doc", "left").select("doc", "text", F.coalesce("n", F.lit(0)).cast("bigint").alias("untouched"))


# --- placement -------------------------------------------------------------------------------------------------

_ROUTES = """with recursive g as (select user_id, cast('0x' || substr(sha256('{"v":' || user_id || '}'), 1, 8) as bigint) as route_id from (select distinct user_id from events)), jump(user_id, route_id, k, b, nxt) as (
  select user_id, route_id, cast(route_id as uhugeint), cast(0 as bigint), cast(0 as bigint) from g
  union all
  select user_id, route_id, (k * 2862933555777941757 + 1) % 18446744073709551616, nxt, cast(floor((nxt + 1) * (2147483648.0::double / (cast(((k * 2862933555777941757 + 1) % 18446744073709551616) // 8589934592 as double) + 1))) as bigint) from jump where nxt < 16
), routed as (select user_id, route_id, cast(max(b) as int) as bucket from jump group by 1, 2)
"""


@_query(_ROUTES + "select user_id, route_id, bucket as partition from routed")
def route_hash(spark, sf_dir):
    """Route and partition of every group."""
    groups = _table(spark, sf_dir, "events").select("user_id").distinct().withColumn("route_id", routing.route_id(F.col("user_id")))
    return groups.withColumn("partition", routing.bucket(F.col("route_id"), 16))


@_query(_ROUTES + "select event_id, user_id, bucket as partition from events join routed using (user_id)")
def route_placement(spark, sf_dir):
    """The partition that every event is in once its group is placed."""
    return routing.place(_table(spark, sf_dir, "events").select("event_id", "user_id"), "user_id", 16).withColumn("partition", F.spark_partition_id())


from tidelog.plans import nodes  # noqa: E402, F401  registers the queries of whole nodes, which build on what is here
