"""Collaborative text: anchors in a tree, their texts per branch, merge, rendering and diff.

An edit adds anchors (each at a character offset of its parent's text, or at the root), a text for each, and deletes earlier ones.
Siblings are ordered by offset, then newest first: offset up, tx_id down, route_id down, index down, sender up.
"""

from __future__ import annotations

import bisect
import collections
import itertools
import re
from collections.abc import Callable, Collection, Iterable, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidelog.schema import ANCHOR, TEXT_UPDATE

SIBLINGS = ("offset", "-tx_id", "-route_id", "-idx", "sender")
FIELDS = ("tx_id", "route_id", "idx", "sender")
Anchor = tuple  # (tx_id, route_id, idx, sender)
ROOT: Anchor | None = None


# --- updates -------------------------------------------------------------------------------------------------


def update(new_anchors: Sequence[tuple[Anchor | None, int]] = (), new_strings: Sequence[str] = (), deletions: Sequence[Anchor] = ()) -> dict:
    """An edit. Anchors and strings are parallel."""
    if len(new_anchors) != len(new_strings):
        raise ValueError("each new anchor needs a string")
    return {"new_anchors": [{"parent": p, "offset": o} for p, o in new_anchors], "new_strings": list(new_strings), "deletions": list(deletions)}


def deletions(*anchors: Anchor) -> dict:
    return update(deletions=anchors)


def size(upd: dict) -> int:
    """How many anchors an edit adds and deletes."""
    return len(upd["new_anchors"]) + len(upd["deletions"])


def is_empty(upd: dict) -> bool:
    return not size(upd)


def valid_update(col):
    """Whether an update column is well formed: strings parallel to anchors and no negative offset."""
    return (F.size(col["new_anchors"]) == F.size(col["new_strings"])) & ~F.exists(col["new_anchors"], lambda a: a["offset"] < 0)


def as_anchor(value) -> Anchor | None:
    if value is None:
        return None
    if isinstance(value, tuple) and not hasattr(value, "asDict"):
        return value
    get = value.get if hasattr(value, "get") else lambda k: value[k]
    return tuple(get(k) for k in FIELDS)


# --- aggregates over DataFrames ------------------------------------------------------------------------------


def anchors(edits: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, anchor, parent, offset) of all anchors that edits add, each once however often its event is applied.

    ``edits`` has doc, tx_id, route_id, sender and ``edit``. A null parent is the root.
    """
    each = edits.select(doc, "tx_id", "route_id", "sender", F.posexplode("edit.new_anchors").alias("idx", "a"))
    anchor = F.struct("tx_id", "route_id", F.col("idx").cast("int").alias("idx"), "sender").cast(ANCHOR)
    return each.select(doc, anchor.alias("anchor"), F.col("a.parent").alias("parent"), F.col("a.offset").alias("offset")).dropDuplicates([doc, "anchor"])


def sibling_order() -> list:
    """The sort of an anchor's children."""
    return [F.col("offset").asc(), F.col("anchor.tx_id").desc(), F.col("anchor.route_id").desc(), F.col("anchor.idx").desc(), F.col("anchor.sender").asc()]


def children(tree: DataFrame, doc: str, parent) -> DataFrame:
    return tree.where(F.col("parent").eqNullSafe(parent)).orderBy(doc, *sibling_order())


def parents(tree: DataFrame, doc: str = "doc") -> DataFrame:
    """How many anchors of each document, the root included, have children."""
    return tree.groupBy(doc).agg(F.count_distinct(F.coalesce(F.to_json("parent"), F.lit("root"))).alias("parents"))


def apply_texts(edits: DataFrame, keys: Sequence[str] = ("doc", "branch"), ord_col: str = "ord") -> DataFrame:
    """(keys, anchor, text): the non-empty strings that edits insert and no edit at the same or a later position deletes."""
    strings = edits.select(*keys, F.col(ord_col).alias("__at"), "tx_id", "route_id", "sender", F.posexplode("edit.new_strings").alias("idx", "text")).where("text <> ''")
    made = strings.select(*keys, "__at", F.struct("tx_id", "route_id", F.col("idx").cast("int").alias("idx"), "sender").cast(ANCHOR).alias("anchor"), "text")
    gone = edits.select(*keys, F.col(ord_col).alias("__gone"), F.explode("edit.deletions").alias("anchor")).groupBy(*keys, "anchor").agg(F.max("__gone").alias("__gone"))
    alive = made.join(gone, [*keys, "anchor"], "left").where(F.col("__gone").isNull() | (F.col("__gone") < F.col("__at")))
    return alive.groupBy(*keys, "anchor").agg(F.max_by("text", "__at").alias("text"))


def merge(left: DataFrame, right: DataFrame, keys: Sequence[str], text: str = "text") -> DataFrame:
    """All anchors of both sides; where both have one, the right side's text. What the right side deleted isn't known here."""
    renamed = right.select(*keys, F.col(text).alias("__right"))
    return left.join(renamed, list(keys), "full_outer").select(*keys, F.coalesce("__right", text).alias(text))


def is_deleted(ids: DataFrame, texts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The given anchors that have no text."""
    return ids.join(texts, list(keys), "left_anti")


# --- one document in memory ----------------------------------------------------------------------------------


class Tree:
    """The anchors of one document: each parent's children in sibling order."""

    def __init__(self, rows: Iterable[tuple[Anchor, Anchor | None, int]] = ()):
        self._below: dict[Anchor | None, dict[Anchor, int]] = {}
        for anchor, parent, offset in rows:
            self.add(anchor, parent, offset)

    def add(self, anchor: Anchor, parent: Anchor | None, offset: int) -> None:
        self._below.setdefault(parent, {}).setdefault(anchor, offset)

    def apply(self, event: tuple[int, int, str], upd: dict) -> None:
        """``event`` is (tx_id, route_id, sender)."""
        for idx, a in enumerate(upd["new_anchors"]):
            self.add((event[0], event[1], idx, event[2]), as_anchor(a["parent"]), a["offset"])

    def children(self, parent: Anchor | None) -> list[tuple[Anchor, int]]:
        return sorted(self._below.get(parent, {}).items(), key=lambda c: (c[1], -c[0][0], -c[0][1], -c[0][2], c[0][3]))

    def offsets(self, parent: Anchor | None) -> Collection[int]:
        """Where a parent's children stand."""
        return self._below.get(parent, {}).values()

    def __len__(self) -> int:
        return len(self._below)

    def __contains__(self, parent: Anchor | None) -> bool:
        return parent in self._below


def edit_texts(texts: dict[Anchor, str], event: tuple[int, int, str], upd: dict) -> None:
    """Apply an edit in place: non-empty strings come, then deletions go."""
    for idx, s in enumerate(upd["new_strings"]):
        if s:
            texts[(event[0], event[1], idx, event[2])] = s
    for d in upd["deletions"]:
        texts.pop(as_anchor(d), None)


def apply_edit(texts: dict[Anchor, str], event: tuple[int, int, str], upd: dict) -> dict[Anchor, str]:
    """The texts after an edit; ``texts`` itself stays."""
    out = dict(texts)
    edit_texts(out, event, upd)
    return out


def merge_texts(left: dict[Anchor, str], right: dict[Anchor, str]) -> dict[Anchor, str]:
    return {**left, **right}


def segments(tree: Tree, texts: dict[Anchor, str]) -> list[tuple[Anchor, int, str]]:
    """(anchor, offset, text) in reading order: a parent's text is split where its children stand, and offsets beyond its end count as its end.
    A deleted parent has no text but keeps its children."""
    out: list[tuple[Anchor, int, str]] = []
    stack: list = [("visit", ROOT)]
    while stack:
        kind, what = stack.pop()
        if kind == "emit":
            out.append(what)
            continue
        body = texts.get(what) if what is not ROOT else None
        plan: list = []
        at = 0
        for child, offset in tree.children(what):
            if body is not None:
                pos = min(offset, len(body))
                if pos > at:
                    plan.append(("emit", (what, at, body[at:pos])))
                at = max(at, pos)
            plan.append(("visit", child))
        if body is not None and at < len(body):
            plan.append(("emit", (what, at, body[at:])))
        stack.extend(reversed(plan))
    return out


def render_text(tree: Tree, texts: dict[Anchor, str]) -> str:
    return "".join(s for _, _, s in segments(tree, texts))


class Document:
    """A document as one branch shows it: its tree and that branch's texts."""

    def __init__(self, tree: Tree, texts: dict[Anchor, str]):
        self.tree, self.texts = tree, texts

    def segments(self) -> list[tuple[Anchor, int, str]]:
        return segments(self.tree, self.texts)

    def text(self) -> str:
        return render_text(self.tree, self.texts)

    def diff(self, target: str) -> dict:
        return diff_text(self.tree, self.texts, target)


FEW_EDITS = 400


def _shortest(a: Sequence, b: Sequence, most: int) -> list[tuple[int, int]] | None:
    """The matched places (i, j) of a shortest edit script (Myers), or None if it takes more than ``most`` insertions and deletions.

    No script is shorter than the items that one side has more often than the other, so the search starts with that bound, which is often met, and doubles it.
    """
    most, more = min(most, len(a) + len(b)), collections.Counter(a)
    more.subtract(collections.Counter(b))
    least = sum(map(abs, more.values()))
    if least > most:
        return None
    bound = min(most, max(least, 16))
    while (found := _within(a, b, bound)) is None and bound < most:
        bound = min(most, 2 * bound)
    return found


def _within(a: Sequence, b: Sequence, most: int) -> list[tuple[int, int]] | None:
    """A round tries only the diagonals from which the end can still be reached within ``most``. What comes to one of them comes from one, so the script is the
    same whatever the bound is."""
    n, m = len(a), len(b)
    off, end = most + 1, n - m
    best, trail = [-1] * (2 * most + 3), []  # the furthest i of diagonal k at off + k
    low = high = 1
    best[off + 1] = 0
    for d in range(most + 1):
        trail.append((low, best[off + low : off + high + 1]))
        low, high = max(-d, end - (most - d)), min(d, end + (most - d))
        low, high = low + ((low + d) & 1), high - ((high + d) & 1)
        for k in range(low, high + 1, 2):
            i, right = best[off + k + 1], best[off + k - 1] + 1
            if k != -d and (k == d or i < right):
                i = right
            j = i - k
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            best[off + k] = i
            if i >= n and j >= m:
                return _back(trail, n, m)
    return None


def _back(trail: list[tuple[int, list[int]]], i: int, j: int) -> list[tuple[int, int]]:
    """The matches on the way back through the furthest points of every round."""
    pairs = []
    for d in range(len(trail) - 1, -1, -1):
        (low, best), k = trail[d], i - j
        back = k + 1 if k == -d or (k != d and best[k - 1 - low] < best[k + 1 - low]) else k - 1
        from_i = best[back - low]
        from_j = from_i - back
        while i > from_i and j > from_j:
            i, j = i - 1, j - 1
            pairs.append((i, j))
        i, j = from_i, from_j
    return pairs[::-1]


def _matches(a: Sequence, b: Sequence) -> list[tuple[int, int]]:
    """Matched places of two sequences, in order: a shortest script where it is short, else what is alike around items that either has once."""
    low = 0
    while low < min(len(a), len(b)) and a[low] == b[low]:
        low += 1
    high = 0
    while high < min(len(a), len(b)) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    out = [(k, k) for k in range(low)]
    x, y = a[low : len(a) - high], b[low : len(b) - high]
    if len(x) and len(y):
        inner = _shortest(x, y, FEW_EDITS)
        if inner is None:
            inner = []
            count_a, count_b = collections.Counter(x), collections.Counter(y)
            at_b = {w: j for j, w in enumerate(y) if count_b[w] == 1}
            tails: list[int] = []
            ends: list[tuple[int, int, int]] = []
            for i, w in enumerate(x):  # the longest run of such items that comes in the same order
                if count_a[w] == 1 and w in at_b:
                    k = bisect.bisect_left(tails, at_b[w])
                    tails[k : k + 1] = [at_b[w]]
                    ends.append((k, i, at_b[w]))
            chain, want = [], len(tails) - 1
            for k, i, j in reversed(ends):
                if k == want and (not chain or j < chain[-1][1]):
                    chain.append((i, j))
                    want -= 1
            last = (-1, -1)
            for i, j in [*chain[::-1], (len(x), len(y))] if chain else []:
                inner += [(last[0] + 1 + p, last[1] + 1 + q) for p, q in _matches(x[last[0] + 1 : i], y[last[1] + 1 : j])]
                if i < len(x):
                    inner.append((i, j))
                last = (i, j)
        out += [(low + i, low + j) for i, j in inner]
    return out + [(len(a) - high + k, len(b) - high + k) for k in range(high)]


def matched(a: str, b: str) -> list[tuple[int, int]]:
    """The characters of ``a`` that stay, with their places in ``b``. Long edits are matched by words first, then within what differs."""
    direct = _shortest(a, b, FEW_EDITS) if abs(len(a) - len(b)) <= FEW_EDITS else None
    if direct is not None:
        return direct
    words_a, words_b = (re.findall(r"\s|[^\s]+", t) for t in (a, b))
    starts = [list(itertools.accumulate(map(len, w), initial=0)) for w in (words_a, words_b)]
    out, last = [], (0, 0)
    for i, j in [*_matches(words_a, words_b), (len(words_a), len(words_b))]:
        la, lb, ia, jb = starts[0][last[0]], starts[1][last[1]], starts[0][i], starts[1][j]
        if ia > la and jb > lb:
            out += [(la + p, lb + q) for p, q in _shortest(a[la:ia], b[lb:jb], FEW_EDITS) or []]
        if i < len(words_a):
            out += [(ia + k, jb + k) for k in range(len(words_a[i]))]
        last = (i + 1, j + 1)
    return out


def diff_text(tree: Tree, texts: dict[Anchor, str], target: str) -> dict:
    """The edit that turns the document into ``target``.

    An anchor that loses characters is deleted whole, and what survives of each of its segments, with what is inserted there, is a child of that anchor in
    the segment's place. Every other insertion becomes a child where it stands. No anchor that keeps all its characters is deleted, so concurrent edits
    elsewhere keep their places.
    """
    parts = segments(tree, texts)
    current = "".join(s for _, _, s in parts)
    stays = [False] * len(current)
    added: dict[int, str] = {}
    done = 0
    last = 0
    for i, j in [*matched(current, target), (len(current), len(target))]:
        if j > done:
            added[last] = target[done:j]  # after the character that stayed last
        if i < len(current):
            stays[i], done, last = True, j + 1, i + 1
    starts = list(itertools.accumulate((len(s) for _, _, s in parts), initial=0))
    lost = {a for k, (a, _, s) in enumerate(parts) if not all(stays[starts[k] : starts[k + 1]])}
    new, strings = [], []

    def hang(anchor: Anchor | None, offset: int, s: str) -> None:
        if s:
            new.append((anchor, offset))
            strings.append(s)

    owed = ""  # inserted right before the segment at hand
    taken: dict[Anchor, set[int]] = {}
    if not parts:
        hang(ROOT, 0, target)
    for k, (anchor, offset, s) in enumerate(parts):
        base = starts[k]
        at_start = owed + (added.get(0, "") if k == 0 else "")
        owed = ""
        after = added.get(base + len(s), "") if len(s) else ""
        if anchor in lost:
            body = at_start + "".join((s[j] if stays[base + j] else "") + (added.get(base + j + 1, "") if j + 1 < len(s) else "") for j in range(len(s))) + after
            if anchor not in taken:
                taken[anchor] = set(tree.offsets(anchor))
            # newest stands first among siblings of one offset, so after those that are there it is one further
            hang(anchor, offset + 1 if offset in taken[anchor] else offset, body)
        else:
            hang(anchor, offset, at_start)
            for j in range(1, len(s)):
                hang(anchor, offset + j, added.get(base + j, ""))
            if after and k + 1 < len(parts) and parts[k + 1][0] in lost:
                owed = after
            else:
                hang(anchor, offset + len(s), after)
    return update(new, strings, sorted(lost))


# --- rendering at scale --------------------------------------------------------------------------------------


SLICE = 512


def _tree_of(rows: Iterable[dict]) -> Tree:
    return Tree((as_anchor(r["anchor"]), as_anchor(r["parent"]), r["offset"]) for r in rows)


def _branches(rows: Iterable[dict], rest: Sequence[str]) -> dict[tuple, dict[Anchor, str]]:
    """The texts of each branch of a document."""
    out: dict[tuple, dict[Anchor, str]] = {}
    for r in rows:
        out.setdefault(tuple(r[c] for c in rest), {})[as_anchor(r["anchor"])] = r["text"]
    return out


def _by_document(tree: DataFrame, other: DataFrame, doc: str, shape: str, run: Callable[[list[dict], list[dict]], Iterable[tuple]]) -> DataFrame:
    """``run`` over the rows of each document on both sides, which are sorted by document and streamed, so that a small document costs no more than its rows."""
    schema = to_arrow_schema(StructType.fromDDL(shape))
    kinds = [df.select(F.struct(*df.columns).alias("r")).schema["r"].dataType for df in (tree, other)]
    none = [F.lit(None).cast(k) for k in kinds]
    rows = tree.select(F.col(doc).alias("__d"), F.struct(*tree.columns).alias("__l"), none[1].alias("__r")).unionByName(other.select(F.col(doc).alias("__d"), none[0].alias("__l"), F.struct(*other.columns).alias("__r")))

    def of(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        at, left, right = None, [], []
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE):
                out: list[tuple] = []
                for d, l, r in zip(*(c.to_pylist() for c in batch.slice(start, SLICE).columns)):
                    if d != at and (left or right):
                        out += run(left, right)
                        left, right = [], []
                    at = d
                    (right if l is None else left).append(r if l is None else l)
                if out:
                    yield packed(out)
        if left or right:
            out = list(run(left, right))
            if out:
                yield packed(out)

    def packed(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(values, f.type) for values, f in zip(zip(*out), schema)], schema=schema)

    return rows.repartition("__d").sortWithinPartitions("__d").mapInArrow(of, shape)


def render(tree: DataFrame, texts: DataFrame, keys: Sequence[str] = ("doc", "branch")) -> DataFrame:
    """(keys, text): every document as it reads. ``tree`` has the first key only: branches share a document's anchors."""
    (doc, *rest), types = keys, {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(anchor_rows: list[dict], text_rows: list[dict]) -> Iterable[tuple]:
        shape = _tree_of(anchor_rows)
        for values, part in _branches(text_rows, rest).items():
            yield text_rows[0][doc], *values, render_text(shape, part)

    return _by_document(tree, texts, doc, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", text string", run)


def render_segments(tree: DataFrame, texts: DataFrame, keys: Sequence[str] = ("doc", "branch")) -> DataFrame:
    """(keys, position, anchor, offset, text): the pieces of every document in reading order."""
    (doc, *rest), types = keys, {f.name: f.dataType.simpleString() for f in texts.schema}

    def run(anchor_rows: list[dict], text_rows: list[dict]) -> Iterable[tuple]:
        shape = _tree_of(anchor_rows)
        for values, part in _branches(text_rows, rest).items():
            for k, (a, o, s) in enumerate(segments(shape, part)):
                yield text_rows[0][doc], *values, k, dict(zip(FIELDS, a)), o, s

    return _by_document(tree, texts, doc, ", ".join(f"`{k}` {types[k]}" for k in keys) + f", position int, anchor {ANCHOR}, offset int, text string", run)


def _update_row(upd: dict) -> dict:
    new = [{"parent": None if p["parent"] is None else dict(zip(FIELDS, p["parent"])), "offset": p["offset"]} for p in upd["new_anchors"]]
    return {"new_anchors": new, "new_strings": upd["new_strings"], "deletions": [dict(zip(FIELDS, d)) for d in upd["deletions"]]}


def diff_documents(tree: DataFrame, texts: DataFrame, targets: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, edit): the edit that turns each document into its target. ``texts`` has doc, anchor, text of one branch, ``targets`` doc and target."""
    kind = targets.schema[doc].dataType.simpleString()
    none = F.lit(None).cast(ANCHOR)
    rows = texts.select(doc, "anchor", "text", F.lit(None).cast("string").alias("target")).unionByName(targets.select(doc, none.alias("anchor"), F.lit(None).cast("string").alias("text"), "target"))

    def run(anchor_rows: list[dict], text_rows: list[dict]) -> Iterable[tuple]:
        wanted = [r for r in text_rows if r["target"] is not None]
        if wanted:
            had = Document(_tree_of(anchor_rows), _branches((r for r in text_rows if r["target"] is None), []).get((), {}))
            for r in wanted:
                yield r[doc], _update_row(had.diff(r["target"]))

    return _by_document(tree, rows, doc, f"`{doc}` {kind}, edit {TEXT_UPDATE}", run)


def diff_column(old, new):
    """The edit (as an update column) that turns a one-anchor document holding ``old`` into ``new``; the anchor is (0, 0, 0, '')."""

    @F.pandas_udf(TEXT_UPDATE)
    def of(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        rows = [_update_row(Document(*single(was or "")).diff(now or "")) for was, now in zip(a, b)]
        return pd.DataFrame(rows, columns=["new_anchors", "new_strings", "deletions"])

    return of(old, new)


def single(body: str) -> tuple[Tree, dict[Anchor, str]]:
    """A document of one anchor."""
    first = (0, 0, 0, "")
    return Tree([(first, ROOT, 0)]), ({first: body} if body else {})
