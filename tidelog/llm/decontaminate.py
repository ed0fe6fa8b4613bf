"""Benchmark decontamination by SimHash windows of each item's size.

A document window has as many words as the item it is held against; a document of fewer words is one window as a whole. Windows and items have
256-bit SimHash fingerprints over weighted shingles of words without punctuation. A multi-index of four 64-bit blocks finds every item within the
radius: by the pigeonhole principle one block differs in no more than a quarter of it, which fewer than one in a hundred unlike pairs do. The exact
weighted Jaccard similarity of the shingle multisets verifies. Before that, positions whose shingles can't reach the threshold by weight are skipped,
which loses nothing: similarity at least t needs shared weight at least t times the item's.

A shingle of the item weighs the more, the fewer items of the whole benchmark hold it; one that the item hasn't got weighs as one that a single item has.
So a similarity depends on the window, the item and the benchmark, and not on how the benchmark is cut into parts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._session import dropped, written
from tidelog.llm._text import PUNCTUATION, U, _power, buffers, flat_ranges, gram_hashes, mix, slices, word_bounds, word_hashes

BLOCKS = 4
_DRAWS = np.random.default_rng(0x51B4).integers(1, 2**63, BLOCKS, dtype=np.uint64)


def radius_for(threshold: float, sigmas: float = 3.1) -> int:
    """The Hamming radius within which a pair right at the Jaccard threshold lies with about 0.999 probability."""
    bits = 64 * BLOCKS
    p = math.acos(min(1.0, 2 * threshold / (1 + threshold))) / math.pi
    return min(bits - 1, math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p))))


def within(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(whether the multi-index looks at the pair, whether it is within the radius) for fingerprints of (..., BLOCKS) words."""
    apart = np.bitwise_count(a ^ b).astype(np.int64)
    looked = (apart <= radius // BLOCKS).any(axis=-1)
    return looked, looked & (apart.sum(axis=-1) <= radius)


def simhash(hashes: np.ndarray, weights: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Fingerprints of ranges of weighted shingles; a bit is set where the weights of set bits exceed those of clear ones."""
    out = np.zeros((len(starts), BLOCKS), np.uint64)
    step = int(min(64, max(1, (1 << 20) // max(len(hashes), 1))))
    for k in range(BLOCKS):
        drawn = mix(hashes + _DRAWS[k])
        for low in range(0, 64, step):
            bits = np.arange(low, min(low + step, 64), dtype=np.uint64)
            run = np.zeros((len(hashes) + 1, len(bits)))
            np.cumsum(np.where((drawn[:, None] >> bits) & U(1) == 1, weights[:, None], -weights[:, None]), axis=0, out=run[1:])
            out[:, k] |= ((run[ends] - run[starts] > 1e-9).astype(np.uint64) << bits).sum(axis=1, dtype=np.uint64)
    return out


def _words(text: pa.Array, bare: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words and each text's range of words; with ``bare`` without ASCII punctuation, and a word of that alone is none."""
    data, offsets = buffers(pc.utf8_lower(text))
    if bare:
        keep = ~PUNCTUATION[data]
        data, offsets = data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets]
    return word_hashes(data, offsets)


def _written(text: pa.Array) -> np.ndarray:
    """Which of a text's words each of its words without punctuation is."""
    data, offsets = buffers(text)
    starts, ends, _ = word_bounds(data, offsets)
    kept = np.concatenate([[0], np.cumsum(~PUNCTUATION[data])])
    return np.flatnonzero(kept[ends] > kept[starts])


def _shingles(text: pa.Array, n: int, bare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingles, offsets, word counts)."""
    words, per = _words(text, bare)
    return *gram_hashes(words, per, n), np.diff(per)


class Items:
    """A part of the benchmark as arrays: items by size, their shingles, weights and fingerprints.

    ``count`` is the number of items of the whole benchmark, and ``shared`` (shingles in order, numbers) says how many of those hold a shingle
    where more than one does; without them the part is the whole.
    """

    def __init__(self, ids: list, text: pa.Array, threshold: float, n: int, radius: int, bare: bool = True, count: int | None = None, shared: tuple[np.ndarray, np.ndarray] | None = None):
        self.threshold, self.n, self.radius, self.bare = threshold, n, radius, bare
        hashes, offsets, words = _shingles(text, n, bare)
        some = [k for k in range(len(ids)) if words[k]]
        sets = [np.unique(hashes[offsets[k] : offsets[k + 1]], return_counts=True) for k in some]
        self.ids = [ids[k] for k in some]
        self.known, df = np.unique(np.concatenate([s[0] for s in sets]), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0))
        if shared is not None:
            df = np.ones(len(self.known), np.int64)
            if len(shared[0]):
                at = np.minimum(np.searchsorted(shared[0], self.known), len(shared[0]) - 1)
                df = np.where(shared[0][at] == self.known, shared[1][at], 1)
        total = len(some) if count is None else count
        self.weight = np.log1p(total / df) if len(df) else np.zeros(0)
        self.foreign = math.log1p(max(1, total))
        self.hashes = [s[0] for s in sets]
        self.counts = [s[1].astype(float) for s in sets]
        flat = np.concatenate(self.hashes) if sets else np.zeros(0, np.uint64)
        place = np.searchsorted(self.known, flat)
        ends = np.concatenate([[0], np.cumsum([len(h) for h in self.hashes])]).astype(np.int64)
        self.weights = [self.weight[place[a:b]] for a, b in zip(ends[:-1], ends[1:])]
        self.total = np.array([float((w * c).sum()) for w, c in zip(self.weights, self.counts)])
        heavy = np.concatenate([w * c for w, c in zip(self.weights, self.counts)]) if sets else np.zeros(0)
        self.fingerprints = simhash(flat, heavy, ends[:-1], ends[1:])
        self.sizes = words[some] if len(some) else np.zeros(0, np.int64)
        self.by_size = {int(s): np.flatnonzero(self.sizes == s) for s in np.unique(self.sizes)}
        self.least = {s: float(self.total[k].min()) for s, k in self.by_size.items()}
        # the items that hold each known shingle
        holder = np.repeat(np.arange(len(sets)), np.diff(ends))
        self.holder = holder[np.argsort(place, kind="stable")]
        self.holders = np.concatenate([[0], np.cumsum(np.bincount(place, minlength=len(self.known)))]).astype(np.int64)
        self.sieve = np.zeros(1 << 20, bool)
        self.sieve[(self.known & U((1 << 20) - 1)).astype(np.int64)] = True

    def weight_for(self, hashes: np.ndarray, item: int) -> tuple[np.ndarray, np.ndarray]:
        """(which shingles the item holds, what each weighs beside it)."""
        own = self.hashes[item]
        at = np.minimum(np.searchsorted(own, hashes), len(own) - 1)
        held = own[at] == hashes
        return held, np.where(held, self.weights[item][at], self.foreign)

    def similarity(self, hashes: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of a window's shingles and an item's, as multisets."""
        own, count = np.unique(hashes, return_counts=True)
        held, weight = self.weight_for(own, item)
        at = np.searchsorted(self.hashes[item], own[held])
        shared = float((weight[held] * np.minimum(count[held], self.counts[item][at])).sum())
        return round(shared / (float((weight * count).sum()) + self.total[item] - shared), 9)

    def find(self, text: pa.Array) -> Iterator[tuple[int, object, int, int, float]]:
        """(row, item id, first word, words, similarity): the best window of each document and item that reaches the threshold."""
        words, per = _words(text, self.bare)
        for n in sorted({min(self.n, s) for s in self.by_size}):
            sizes = [s for s in self.by_size if min(self.n, s) == n]
            # shingle k of a text begins at its word k; a text too short for one has no window of these sizes
            hashes, offsets = gram_hashes(words, per, n)
            full = np.diff(per) >= n
            hit = self.sieve[(hashes & U((1 << 20) - 1)).astype(np.int64)]
            at = np.flatnonzero(hit)
            spot = np.minimum(np.searchsorted(self.known, hashes[at]), max(len(self.known) - 1, 0))
            true = self.known[spot] == hashes[at]
            at, spot = at[true], spot[true]
            weight = np.zeros(len(hashes) + 1)
            weight[at] = self.weight[spot]
            gained = np.concatenate([[0.0], np.cumsum(weight[:-1])])
            need = self.threshold * min(self.least[s] for s in sizes)
            # no window gains more than the widest one from the same place on
            reach = np.minimum(np.arange(len(hashes)) + max(sizes) - n + 1, len(hashes))
            near = np.zeros(len(full), bool)
            near[np.searchsorted(offsets, np.flatnonzero(gained[reach] - gained[:-1] >= need - 1e-9), side="right") - 1] = True
            for row in np.flatnonzero(full & near).tolist():
                low, high = int(offsets[row]), int(offsets[row + 1])
                mine = spot[slice(*np.searchsorted(at, (low, high)))]
                many = self.holders[mine + 1] - self.holders[mine]
                items = self.holder[flat_ranges(self.holders[mine], many)]
                # only items of whose weight the document as a whole has enough
                sums = np.bincount(items, np.repeat(self.weight[mine], many), len(self.ids))
                able = np.flatnonzero((sums >= self.threshold * self.total - 1e-9) & np.isin(self.sizes, sizes))
                if len(able):
                    found = [hit for k in able.tolist() for hit in self._best(hashes[low:high], n, k)]
                    at_word = _written(text.slice(row, 1)) if found and self.bare else None
                    for item, a, count, value in found:
                        if at_word is not None:  # as the document counts its words, with those of punctuation alone
                            a, count = int(at_word[a]), int(at_word[a + count - 1] - at_word[a]) + 1
                        yield row, item, a, count, value

    def _best(self, own: np.ndarray, n: int, item: int) -> Iterator[tuple[object, int, int, float]]:
        """The item's best window of a document, given the document's shingles, if one reaches the threshold."""
        size = int(self.sizes[item])
        # a document shorter than the item is held against it whole
        span = min(size - n + 1, len(own))
        held, weight = self.weight_for(own, item)
        gained = np.concatenate([[0.0], np.cumsum(np.where(held, weight, 0.0))])
        start = np.flatnonzero(gained[span:] - gained[:-span] >= self.threshold * self.total[item] - 1e-9)
        if not len(start):
            return
        base = int(start[0])
        own, weight, start = own[base : int(start[-1]) + span], weight[base : int(start[-1]) + span], start - base
        # of windows with equal shingles the first stands for all
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(own * _power("up", len(own)))])
        same = mix((run[start + span] - run[start]) * _power("down", len(own) + 1)[start])
        start = start[np.sort(np.unique(same, return_index=True)[1])]
        start = start[within(simhash(own, weight, start, start + span), self.fingerprints[item], self.radius)[1]]
        best = None
        for a in start.tolist():
            value = self.similarity(own[a : a + span], item)
            if value >= self.threshold and (best is None or value > best[0]):
                best = value, a
        if best:
            yield self.ids[item], best[1] + base, span + n - 1, best[0]


def _arrow_ids(df: DataFrame) -> pa.Table:
    """(item_id, text) of a few items, in order of their ids."""
    return df.select("item_id", "text").toArrow().sort_by("item_id")


def _is_bare(text: pa.Array) -> np.ndarray:
    """Which texts have a word that isn't punctuation alone."""
    return np.diff(_words(text, True)[1]) > 0


def _counted(items: DataFrame, n: int) -> DataFrame:
    """(bare, shingle) of every different shingle of each item, and a row of a null shingle for each item that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            text = part.column("text")
            kind = _is_bare(text)
            for bare in (True, False):
                hashes, offsets, words = _shingles(text.filter(pa.array(kind == bare)), n, bare)
                owner = np.repeat(np.arange(len(words)), np.diff(offsets))
                order = np.lexsort((hashes, owner))
                hashes, owner = hashes[order], owner[order]
                first = np.ones(len(hashes), bool)
                first[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
                some = int((words > 0).sum())
                rows = np.concatenate([hashes[first], np.zeros(some, np.uint64)]).view(np.int64)
                gone = np.arange(len(rows)) >= len(rows) - some
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), bare)), pa.array(rows, mask=gone)], names=["bare", "shingle"])

    return items.mapInArrow(run, "bare boolean, shingle bigint")


def _parts(benchmark: DataFrame, threshold: float, n: int, most_bytes: int) -> Iterator[Items]:
    """The benchmark in parts of at most about ``most_bytes`` of text, which is what each task holds at a time."""
    items = benchmark.where("item_id is not null and text is not null").groupBy("item_id").agg(F.min("text").alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // most_bytes))
    counts: dict[bool, int | None] = {True: None, False: None}
    tables: list[DataFrame] = []
    if parts > 1:
        items = written(items, "items")
        df = written(_counted(items, n).groupBy("bare", "shingle").agg(F.count("*").alias("n")).where("n > 1 or shingle is null"), "shingles")
        counts |= {r.bare: r.n for r in df.where("shingle is null").collect()}
        tables = [items, df]
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else items
        rows = _arrow_ids(part)
        text = rows.column("text").combine_chunks() if rows.num_rows else pa.array([], pa.string())
        kind = _is_bare(text)
        shared = _counted(part, n).where("shingle is not null").distinct().join(tables[1].where("shingle is not null"), ["bare", "shingle"]).toArrow().sort_by("shingle") if parts > 1 else None
        for bare in (True, False):  # items of punctuation alone are held against words as they are written
            mine = pa.array(kind == bare)
            own = text.filter(mine)
            if bare or np.diff(_words(own, False)[1]).any():
                known = None
                if shared is not None:
                    of = shared.filter(pc.equal(shared.column("bare"), bare))
                    known = np.asarray(of.column("shingle"), np.int64).view(np.uint64), np.asarray(of.column("n"), np.int64)
                    order = np.argsort(known[0])
                    known = known[0][order], known[1][order]
                yield Items(rows.column("item_id").filter(mine).to_pylist(), own, threshold, n, radius_for(threshold), bare, counts[bare], known)
    for table in tables:
        dropped(table)


def contaminations(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, n: int = 3, most_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): for each document and benchmark item the best window that reaches the threshold.

    A document of fewer words than the item is one window. Words are lower-case and without ASCII
    punctuation, but for an item of punctuation alone; positions count the words of the text as it is written. Null and blank texts and items match nothing;
    rows without id are left out, and an item id that repeats stands for its least text. Repeated documents each give their rows; other
    columns are ignored. Documents are read in one narrow pass for each ``most_bytes`` of benchmark text, without a shuffle; neither windows nor similarities
    depend on the parts. Of equal similarities of a document and an item the leftmost window is given; a similarity right at the threshold counts.
    """
    out = None
    for items in _parts(benchmark, threshold, n, most_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                found = list(items.find(part.column(text_col)))
                yield pa.RecordBatch.from_arrays([part.column(id_col).take(pa.array([f[0] for f in found], pa.int64())), *(pa.array([f[k] for f in found], t) for k, t in ((1, item_kind), (2, pa.int32()), (3, pa.int32()), (4, pa.float64())))], names=[id_col, "item_id", "start_word", "n_words", "similarity"])

        from pyspark.sql.pandas.types import to_arrow_type

        item_kind = to_arrow_type(benchmark.schema["item_id"].dataType)
        schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema['item_id'].dataType.simpleString()}, start_word int, n_words int, similarity double"
        rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
        out = rows if out is None else out.unionByName(rows)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.6, n: int = 3, most_bytes: int = 16 << 20, text_col: str = "text") -> DataFrame:
    """The rows without a window that reaches the threshold, with all their columns; null texts stay."""
    for items in _parts(benchmark, threshold, n, most_bytes):

        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, text_col):
                stay = np.ones(part.num_rows, bool)
                stay[[f[0] for f in items.find(part.column(text_col))]] = False
                yield part.filter(pa.array(stay))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


#: Every window of every pair that has the weight, one by one. For tables whose ids are unique and whose items have three words or more that aren't punctuation alone.
CONTAMINATIONS_SQL = r"""
with iw as (select item_id, unnest(range(len(ws))) as o, ws from (select item_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws from benchmark where item_id is not null and text is not null)),
ib as (select item_id, o, regexp_replace(ws[o + 1], '[!-/:-@\[-`{-~]', '', 'g') as b from iw),
ig as (select item_id, b || ' ' || lead(b) over w || ' ' || lead(b, 2) over w as gram from ib where b <> '' window w as (partition by item_id order by o)),
sizes as (select item_id, count(*) as m from ib where b <> '' group by 1),
bag as (select item_id, gram, count(*) as cnt from ig where gram is not null group by 1, 2),
df as (select gram, ln(1 + (select count(*) from sizes) / count(*)) as weight from bag group by 1),
item as (select item_id, m, sum(weight * cnt) as total from bag join df using (gram) join sizes using (item_id) group by 1, 2),
dw as (select doc_id, unnest(range(len(ws))) as o, ws from (select doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws from documents where doc_id is not null and text is not null)),
db as (select doc_id, o, regexp_replace(ws[o + 1], '[!-/:-@\[-`{-~]', '', 'g') as b from dw),
dn as (select doc_id, o, b || ' ' || lead(b) over w || ' ' || lead(b, 2) over w as gram, row_number() over w - 1 as pos from db where b <> '' window w as (partition by doc_id order by o)),
dg as (select doc_id, pos, gram from dn where gram is not null),
many as (select doc_id, count(*) as grams from dg group by 1),
able as (select doc_id, item_id, m, total, least(m - 2, grams) as span, grams from dg join bag using (gram) join df using (gram) join item using (item_id) join many using (doc_id) group by all having sum(weight) >= 0.6 * total - 1e-9),
spots as (select doc_id, item_id, total, span, unnest(range(grams - span + 1)) as start from able),
held as (select s.doc_id, s.item_id, s.total, s.span, s.start, g.gram, count(*) as n from spots s join dg g on g.doc_id = s.doc_id and g.pos >= s.start and g.pos < s.start + s.span group by all),
judged as (
  select h.doc_id, h.item_id, h.span, h.start, h.total, coalesce(sum(weight * least(n, cnt)), 0) as shared, sum(n * coalesce(case when cnt is not null then weight end, ln(1 + (select count(*) from sizes)))) as own
  from held h left join bag b on b.item_id = h.item_id and b.gram = h.gram left join df on df.gram = b.gram group by all),
best as (select *, round(shared / (own + total - shared), 9) as similarity from judged qualify row_number() over (partition by doc_id, item_id order by round(shared / (own + total - shared), 9) desc, start) = 1)
select b.doc_id, b.item_id, cast(x.o as int) as start_word, cast(y.o - x.o + 1 as int) as n_words, similarity
from best b join dn x on x.doc_id = b.doc_id and x.pos = b.start join dn y on y.doc_id = b.doc_id and y.pos = b.start + b.span + 1 where similarity >= 0.6
"""
