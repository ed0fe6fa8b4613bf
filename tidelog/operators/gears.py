"""Gears: named rules from events, and from other gears' output, to a DataFrame.

A family of gears with a parameter is one gear with that parameter as a column. Gears form an acyclic graph that is checked as they are
registered, and each is evaluated once for a materialisation, whatever reads it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidelog.operators import stategraph, text
from tidelog.operators.text import ROOT, Tree, edit_texts, render_text
from tidelog.schema import GearError

Step = Callable[..., DataFrame]


@dataclass(frozen=True)
class Gear:
    """``step(primary, **secondaries)`` over the signed feed or the winners of event type ``primary``."""

    name: str
    primary: str
    step: Step = field(compare=False)
    secondaries: tuple[str, ...] = ()


class Gears:
    """The registry, and evaluation in dependency order."""

    def __init__(self) -> None:
        self._gears: dict[str, Gear] = {}

    def register(self, gear: Gear) -> Gear:
        if gear.name in self._gears:
            raise GearError(f"gear {gear.name} is defined twice")
        self._gears[gear.name] = gear
        try:
            self.order(gear.name)
        except GearError:
            del self._gears[gear.name]
            raise
        return gear

    def order(self, name: str) -> list[str]:
        """The gears that ``name`` needs, each after its inputs; a gear that isn't there yet is an error when it is evaluated."""
        done: list[str] = []
        path: list[str] = []

        def visit(n: str) -> None:
            if n in path:
                raise GearError(f"gears form a cycle: {' -> '.join([*path, n])}")
            if n in done or n not in self._gears:
                return
            path.append(n)
            for s in self._gears[n].secondaries:
                visit(s)
            path.pop()
            done.append(n)

        visit(name)
        return done

    def materialize(self, name: str, inputs: Mapping[str, DataFrame]) -> DataFrame:
        """The converged output of a gear over ``inputs``, a DataFrame for each event type."""
        out: dict[str, DataFrame] = {}
        if name not in self._gears:
            raise GearError(f"no gear {name}")
        for n in self.order(name):
            gear = self._gears[n]
            missing = [s for s in gear.secondaries if s not in self._gears]
            if missing:
                raise GearError(f"gear {n} reads {', '.join(missing)}, which isn't defined")
            out[n] = gear.step(inputs[gear.primary], **{s: out[s] for s in gear.secondaries})
        return out[name]


# --- linear gears: sums over the signed feed, exact under any order, and incremental by adding a delta's sum ---------


def invites_count(feed: DataFrame, by: str = "branch") -> DataFrame:
    return feed.groupBy(by).agg(F.sum("weight").alias("invites"))


def mulsum(feed: DataFrame, by: str = "bucket") -> DataFrame:
    return feed.groupBy(by).agg(F.sum(F.col("a") * F.col("b") * F.col("weight")).alias("total"))


def doc_counter(feed: DataFrame) -> DataFrame:
    return feed.groupBy("doc", "branch").agg(F.sum(F.col("delta") * F.col("weight")).alias("total"))


def apply_linear(before: DataFrame, delta: DataFrame, keys: list[str], total: str) -> DataFrame:
    """A linear gear's output after a delta: only the delta is aggregated again."""
    return before.unionByName(delta.select(*before.columns)).groupBy(*keys).agg(F.sum(total).alias(total))


def full_fold(events: DataFrame, by: list[str], init, merge, value, out: str) -> DataFrame:
    """The specification of a gear: each group's events folded in order by a column function."""
    rows = F.array_sort(F.collect_list(F.struct("ord", value.alias("v"))))
    return events.groupBy(*by).agg(F.aggregate(rows, init, lambda acc, r: merge(acc, r["v"])).alias(out))


def diff_fold(delta: DataFrame, by: list[str], value, out: str) -> DataFrame:
    """An invertible fold of a delta: added rows count, removed ones count back."""
    return delta.groupBy(*by).agg(F.sum(F.col("weight") * value).alias(out))


# --- folds -----------------------------------------------------------------------------------------------------

ORDER = ("ts", "route_id", "tx_id", "sender")


def invited(invites: DataFrame) -> DataFrame:
    """Membership per branch: a member, at first the creator alone, makes the invited user one from then on.

    ``invites``: branch, creator, user (the sender's), invitee and the order columns. Out: (branch, key, order, value).
    """

    def handler(ctx: stategraph.Context, e: dict) -> None:
        member = ctx.query(e["user"])
        if member if member is not None else e["user"] == e["creator"]:
            ctx.update(e["invitee"], True)

    return stategraph.fold(invites, handler, ["branch"], ORDER, invites.schema["invitee"].dataType.simpleString(), "boolean")


LEVELS = ("None", "User", "Moderator", "Admin")


def access_levels(changes: DataFrame, group: str = "site", order: tuple[str, ...] = ("event",)) -> DataFrame:
    """Access levels: an admin, or nobody in particular (a null admin), sets a user's level. Columns: group, admin, target, level, order."""

    def handler(ctx: stategraph.Context, e: dict) -> None:
        admin = e["admin"]
        if admin is None or admin != admin or ctx.query(int(admin)) == "Admin":
            ctx.update(int(e["target"]), e["level"])

    return stategraph.fold(changes, handler, [group], order, "bigint", "string")


def doc_content(attaches: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(anchors, texts): the anchors of each document and the text of each branch as the last event leaves it.

    ``attaches``: doc, branch, creator (the branch's), user, is_merge, edit, from_branch and the order columns; ``members``: the output of
    ``invited``. An attach counts if its author is a member of its branch at that point. ``texts``: doc, branch, text. Events stream past in
    order, so a task holds one document: its tree and the present text of each branch.
    """
    edits = attaches.where("not is_merge")
    tree = text.anchors(edits)
    # a document needs the membership of its own authors only
    authors = attaches.select("doc", "branch", F.col("user").alias("key")).distinct()
    known = members.join(authors, ["branch", "key"]).select("doc", "branch", "key", "value", *ORDER)
    # a document's membership changes and events in order, the changes first; a branch's texts change in place
    kind = {f.name: f.dataType.simpleString() for f in attaches.schema}
    event = F.struct("branch", F.col("creator").alias("creator"), "user", "is_merge", "edit", "from_branch")
    event_kind = attaches.select(event.alias("e")).schema["e"].dataType
    changes = known.select(
        "doc", *ORDER, F.lit(0).alias("side"), F.col("branch").cast(kind["branch"]).alias("m_branch"), F.col("key").cast(kind["user"]).alias("m_user"),
        F.col("value").alias("m_value"), F.lit(None).cast(event_kind).alias("event"),
    )
    steps = attaches.select(
        "doc", *ORDER, F.lit(1).alias("side"), F.lit(None).cast(kind["branch"]).alias("m_branch"), F.lit(None).cast(kind["user"]).alias("m_user"),
        F.lit(None).cast("boolean").alias("m_value"), event.alias("event"),
    )

    def run(batches):
        here, shape, branches, members_of, out = object(), Tree(), {}, {}, []

        def close() -> None:
            out.extend((here, b, render_text(shape, t)) for b, t in branches.items())

        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)
        for batch in batches:
            for r in batch.to_pylist():
                if r["doc"] != here:
                    close()
                    here, shape, branches, members_of = r["doc"], Tree(), {}, {}
                    if len(out) >= 100:
                        yield give()
                        out = []
                e = r["event"]
                if e is None:
                    members_of[r["m_branch"], r["m_user"]] = r["m_value"]
                    continue
                at = (r["tx_id"], r["route_id"], r["sender"])
                if not e["is_merge"]:
                    shape.apply(at, e["edit"])
                seen = members_of.get((e["branch"], e["user"]))
                if seen if seen is not None else e["user"] == e["creator"]:
                    mine = branches.setdefault(e["branch"], {})
                    if e["is_merge"]:
                        mine.update(branches.get(e["from_branch"], {}))
                    else:
                        edit_texts(mine, at, e["edit"])
        close()
        if out:
            yield give()

    result = T.StructType.fromDDL(f"doc {kind['doc']}, branch {kind['branch']}, text string")
    arrow = to_arrow_schema(result)
    texts = changes.unionByName(steps).repartition("doc").sortWithinPartitions("doc", *ORDER, "side").mapInArrow(run, result)
    return tree, texts


def standard_gears() -> Gears:
    """The rules of this module under their names."""
    out = Gears()
    rules = (
        Gear("invites_count", "Invite", invites_count),
        Gear("mulsum", "MulSumEntry", mulsum),
        Gear("doc_counter", "CounterAttach", doc_counter),
        Gear("invited", "Invite", invited),
        Gear("access_levels", "SiteEvent", access_levels),
        Gear("doc_content", "Attach", lambda attaches, invited: doc_content(attaches, invited)[1], ("invited",)),
    )
    for g in rules:
        out.register(g)
    return out


__all__ = ["ROOT", "Gear", "Gears", "access_levels", "apply_linear", "diff_fold", "doc_content", "doc_counter", "full_fold", "invited", "invites_count", "mulsum", "standard_gears"]
