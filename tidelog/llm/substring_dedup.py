"""Substring deduplication by recompression.

Rounds alternately name runs of one symbol and pairs of neighbours. A pair is named where a coin drawn from each symbol's own name falls
left for the first and right for the second, and a name is a 64-bit hash of what it stands for, so every executor gives equal strings
equal names without exchanging a dictionary, and equal substrings have equal symbols in their interior. A symbol of at least ``span`` words
is final. One shuffle counts final symbols over the corpus; those that occur again reveal where long repeats can be, and
every window of ``window`` words that holds such a symbol is then verified by its full hash in a second one.

A name may be in a third of all texts. Its occurrences meet in one place only once a task's worth of them has been settled: what has an
earlier occurrence in its own task is marked by that, and travels under a key of its own.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._session import unused
from tidelog.llm._text import _power, U, buffers, flat_ranges, lists, mix, slices, word_bounds, word_hashes

_FIRST = 1 << 62
_RUN, _PAIR, _LONG = U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3), U(0x1D8E4E27C47D124F)


def recompress(words: np.ndarray, per_text: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, first words, lengths in words) of the final symbols, in order.

    A run of at least ``span`` words is named by what is repeated alone, so that it matches a run of another length; its length is
    given as a negative number. Rounds go on until no two symbols that aren't final are neighbours.
    """
    n = len(words)
    text = np.repeat(np.arange(len(per_text) - 1), np.diff(per_text))
    symbols, place, size = words.copy(), np.arange(n), np.ones(n, np.int64)
    done = []
    # final symbols stay in the sequence as walls: their names take no further part
    final = np.zeros(n, bool)
    for r in itertools.count():
        open_ = ~final
        if not (open_[1:] & open_[:-1] & (text[1:] == text[:-1])).any():
            break
        same = np.zeros(len(symbols), bool)
        same[1:] = (symbols[1:] == symbols[:-1]) & (text[1:] == text[:-1]) & ~final[1:] & ~final[:-1]
        if same.any():
            at = np.flatnonzero(~same)
            count = np.diff(np.append(at, len(symbols)))
            total = np.add.reduceat(size, at)
            base = symbols[at]
            run = count > 1
            name = base.copy()
            short = run & (total < span)
            long = run & (total >= span)
            name[short] = mix(base[short] * _RUN + count[short].astype(np.uint64))
            name[long] = mix(base[long] * _LONG + U(1))
            symbols, place, text, size, final = name, place[at], text[at], np.where(long, -total, total), final[at] | long
        side = (mix(symbols + U(r * int(_PAIR) % 2**64)) >> U(40)) & U(1) == 1
        left = np.zeros(len(symbols), bool)
        left[:-1] = ~side[:-1] & side[1:] & (text[1:] == text[:-1]) & ~final[:-1] & ~final[1:]
        at = np.flatnonzero(left)
        name = mix((symbols[at] ^ (symbols[at] >> U(31))) * _PAIR + mix(symbols[at + 1] + _RUN))
        symbols[at] = name
        size[at] += size[at + 1]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        symbols, place, text, size, final = symbols[keep], place[keep], text[keep], size[keep], final[keep]
        final |= size >= span
        if r % 3 == 2 and final.any():  # walls between two walls never matter again
            wall = final.copy()
            wall[1:-1] &= final[:-2] & final[2:]
            wall[[0, -1]] = False
            done.append((symbols[wall], place[wall], size[wall]))
            keep = ~wall
            symbols, place, text, size, final = symbols[keep], place[keep], text[keep], size[keep], final[keep]
    done.append((symbols[final], place[final], size[final]))
    name, first, length = (np.concatenate(x) for x in zip(*done))
    order = np.argsort(first, kind="stable")
    return name[order], first[order], length[order]


def _ranges_hash(words: np.ndarray):
    """The function of (first words, words after the last) that hashes ranges of words."""
    prefix = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power("up", len(words)), out=prefix[1:])
    return lambda a, b: mix((prefix[b] - prefix[a]) * _power("down", len(words) + 1)[a])


def _ends(group: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the least and the greatest item of each item's group are, compared by the first of ``order``, then the next."""
    low, high = np.arange(len(group)), np.arange(len(group))
    by = np.argsort(group, kind="stable")
    same = group[by][1:] == group[by][:-1]
    some = np.zeros(len(group), bool)
    some[by[1:][same]] = some[by[:-1][same]] = True
    some = np.flatnonzero(some)
    by = some[np.lexsort([x[some] for x in (*reversed(order), group)])]
    head = np.ones(len(by), bool)
    head[1:] = group[by][1:] != group[by][:-1]
    at, of = np.flatnonzero(head), np.cumsum(head) - 1
    low[by], high[by] = by[at][of], by[np.append(at[1:], len(by)) - 1][of] if len(by) else by
    return low, high


class _Task:
    """The least places so far, in one task, of names that occur at several. ``most`` are remembered, the latest ones; a name that is forgotten
    is settled by the shuffle like one seen first, so the bound changes no result."""

    def __init__(self, most: int = 1 << 14):
        self.most = most
        self.kept: list | None = None

    def settle(self, name: np.ndarray, doc: pa.Array, start: np.ndarray, key: np.ndarray, gap: np.ndarray):
        """(beyond, last, near): whether an occurrence has one before it in this task; whether it is the last of those that are at hand, so that the name
        must still go by it; and the (doc, start, key, gap) of the least one, null where there is no second place."""
        old = self.kept or [name[:0], doc[:0], start[:0], key[:0], gap[:0]]
        held = len(old[0])
        name, start, key, gap = (np.concatenate([a, b]) for a, b in zip((old[0], *old[2:]), (name, start, key, gap)))
        doc = pa.concat_arrays([old[1], doc])
        rank = np.asarray(pc.rank(doc, sort_keys="ascending", tiebreaker="dense"))
        low, high = _ends(name, rank, start, key)
        differ = lambda a, b: (rank[a] != rank[b]) | (start[a] != start[b]) | (key[a] != key[b])
        every = np.arange(len(name))
        twice = differ(low, high)
        lead = np.unique(low[twice | (every < held)])[-self.most :]
        self.kept = [name[lead], doc.take(pa.array(lead)), start[lead], key[lead], gap[lead]]
        beyond, last = differ(every, low)[held:], (~differ(every, high) & (low >= held))[held:]
        at = low[held:]
        pieces = [doc.take(pa.array(at)), pa.array(start[at], pa.int32()), pa.array(key[at], pa.int32()), pa.array(gap[at].view(np.int64))]
        return beyond, last, pa.StructArray.from_arrays(pieces, names=["doc", "start", "key", "gap"], mask=pa.array(~twice[held:]))


def _apart(spread: np.ndarray, start: np.ndarray, salt: np.ndarray | np.uint64) -> np.ndarray:
    """Shuffle keys for rows that need to meet no other."""
    return mix(spread.view(np.uint64) + (start.astype(np.uint64) + U(1)) * _RUN + salt)


def final_symbols(docs: DataFrame, span: int, id_col: str, text_col: str) -> DataFrame:
    """(name, doc, key, start, size, reach, gap, near) of every final symbol; a doc is told from another row of its id by a hash of its text.

    ``reach`` is how far the text's next final symbol begins from here, 0 without one, and ``gap`` hashes the words between. ``near`` is the least
    (doc, start, key, gap) of the symbol in this task, if it occurs at two places there; where that isn't this one, ``name`` is a key of the row's own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task()
        for part in slices(batches, "text"):
            words, per = word_hashes(*buffers(part.column("text")))
            name, first, size = recompress(words, per, span)
            text = np.searchsorted(per, first, side="right") - 1
            reach = np.zeros(len(first), np.int64)
            follows = np.flatnonzero(text[1:] == text[:-1])
            reach[follows] = first[follows + 1] - first[follows]
            gap = np.zeros(len(first), np.uint64)
            wide = np.flatnonzero(reach > np.abs(size))
            gap[wide] = _ranges_hash(words)(first[wide] + np.abs(size[wide]), first[wide] + reach[wide])
            start, doc, key = first - per[text], part.column("doc").take(pa.array(text)), np.asarray(part.column("key"))[text]
            beyond, _, near = task.settle(name, doc, start, key, gap)
            name = np.where(beyond, _apart(np.asarray(part.column("spread"))[text], start, name), name)
            columns = [pa.array(name.view(np.int64)), doc, *(pa.array(x, pa.int32()) for x in (key, start, size, reach)), pa.array(gap.view(np.int64)), near]
            yield pa.RecordBatch.from_arrays(columns, names=["name", "doc", "key", "start", "size", "reach", "gap", "near"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).alias("doc"), F.hash(text_col).alias("key"), F.xxhash64(id_col).alias("spread"), F.col(text_col).alias("text"))
    near = f"struct<doc:{kind},start:int,key:int,gap:bigint>"
    return rows.mapInArrow(run, f"name bigint, doc {kind}, key int, start int, size int, reach int, gap bigint, near {near}")


def _chains(spots: dict[str, np.ndarray], row: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first start, last start, first spot) of windows that symbols verify: a symbol, the words up to the next and that next symbol are as they
    are where the first symbol occurs first, and so on, over at least a window."""
    at, size, first_doc, first_at = (spots[c] for c in ("start", "size", "doc", "at"))
    solid = spots["later"] & (size > 0)
    joins = np.zeros(len(at), bool)
    joins[1:] = (
        solid[1:] & solid[:-1] & spots["tied"][:-1] & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + spots["reach"][:-1])
        & (first_doc[1:] == first_doc[:-1]) & (first_at[1:] == first_at[:-1] + spots["reach"][:-1])
    )
    head = np.flatnonzero(~joins)
    tail = np.append(head[1:], len(at)) - 1 if len(head) else head
    last = at[tail] + size[tail] - window
    good = solid[head] & (last >= at[head])
    return row[head][good], at[head][good], last[good], head[good]


def repeated_windows(docs: DataFrame, window: int, span: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, runs): runs of windows that occur more than once, as first start + 2**32 * (windows - 1), and _FIRST added where the window
    doesn't occur earlier in the corpus, in the order (doc, start).

    Windows inside a chain of symbols that follow each other in the same way where they occur first are verified by the symbols; the others
    that hold a symbol which occurs again are verified by their own hashes.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    symbols = final_symbols(docs, span, id_col, text_col)
    same, place = Window.partitionBy("name"), F.struct("doc", "start", "key")
    met = symbols.withColumns({"n": F.count("*").over(same), "met": F.min(F.struct("doc", "start", "key", "gap")).over(same)})
    again = met.where((F.col("n") > 1) | F.col("near").isNotNull() | (F.abs("size") > window)).withColumn("first", F.least("met", "near"))
    later, tied = place > F.struct(*[F.col(f"first.{c}").alias(c) for c in ("doc", "start", "key")]), F.col("gap") == F.col("first.gap")
    spot = F.struct("start", "size", "reach", F.col("first.doc").alias("doc"), F.col("first.key").alias("key"), F.col("first.start").alias("at"), later.alias("later"), tied.alias("tied"))
    spots = again.groupBy(F.col("doc").alias("__doc"), F.col("key").alias("__key")).agg(F.array_sort(F.collect_set(spot)).alias("spots"))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.hash(text_col).alias("key"), F.col(text_col).alias("text"))
    parts = ("start", "size", "reach", "doc", "key", "at", "later", "tied")
    near = rows.join(spots, (F.col("doc") == F.col("__doc")) & (F.col("key") == F.col("__key"))).select("doc", "key", F.xxhash64("doc").alias("spread"), "text", *[F.col(f"spots.{c}").alias(f"s_{c}") for c in parts])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = _Task()
        for part in slices(batches, "text"):
            words, per = word_hashes(*buffers(part.column("text")))
            found = {c: part.column(f"s_{c}").flatten().to_numpy(zero_copy_only=False) for c in parts}
            found |= {c: found[c].astype(np.int64) for c in ("start", "size", "reach", "at")}
            owner = np.repeat(np.arange(part.num_rows), np.diff(np.asarray(part.column("s_start").offsets)))
            at, count, length = found["start"], np.diff(per)[owner], np.abs(found["size"])
            # the windows that hold the symbol whole; of a longer one, those that it holds or that hold most of it
            low = np.maximum(np.minimum(at + length - window, at - window + span), 0)
            high = np.minimum(np.maximum(at, at + length - span), count - window)
            ok = high >= low
            sure, begin, end, spot = _chains(found, owner, window)
            mark, known = np.zeros(len(words) + 1, np.int64), np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, (per[owner] + low)[ok], 1)
            np.add.at(mark, (per[owner] + high)[ok] + 1, -1)
            np.add.at(known, per[sure] + begin, 1)
            np.add.at(known, per[sure] + end + 1, -1)
            chosen = np.flatnonzero((np.cumsum(mark[:-1]) > 0) & (np.cumsum(known[:-1]) == 0))
            hashed = _ranges_hash(words)(chosen, chosen + window)
            text = np.searchsorted(per, chosen, side="right") - 1
            start, doc, key, spread = chosen - per[text], part.column("doc").take(pa.array(text)), np.asarray(part.column("key")), np.asarray(part.column("spread"))
            # the least and the last of a task's equal windows meet those of other tasks; what lies between has an earlier one, and runs of it go along as verified
            beyond, last, _ = task.settle(hashed, doc, start, key[text], np.zeros(len(start), np.uint64))
            calm = np.flatnonzero(beyond & ~last)
            head = np.flatnonzero(np.concatenate([[True], (chosen[calm][1:] != chosen[calm][:-1] + 1) | (text[calm][1:] != text[calm][:-1])])[: len(calm)])
            tail = np.append(head[1:], len(calm)) - 1 if len(head) else head
            of, begins, ends = (np.concatenate(x) for x in ((sure, text[calm][head]), (begin, start[calm][head]), (end, start[calm][tail])))
            open_ = np.delete(np.arange(len(chosen)), calm)
            # a verified run has a key of its own and the sign of its place turned, and so has the one it repeats, each once
            own, long = _apart(spread[of], begins, _PAIR), (end - begin) << 32
            origin = pa.table([part.column("s_doc").flatten().take(pa.array(spot)), part.column("s_key").flatten().take(pa.array(spot)), pa.array(~(found["at"][spot] | long | _FIRST)), pa.array(np.arange(len(spot)))], names=["doc", "key", "run", "by"])
            origin = origin.group_by(["doc", "key", "run"], use_threads=False).aggregate([("by", "min")]).combine_chunks()
            column = lambda c: origin.column(c).combine_chunks()
            theirs = mix(own[np.asarray(origin.column("by_min"))] + _PAIR)
            docs_of = pa.concat_arrays([doc.take(pa.array(open_)), part.column("doc").take(pa.array(of)), column("doc")])
            keys_of = pa.concat_arrays([pa.array(key[text[open_]], pa.int32()), pa.array(key[of], pa.int32()), column("key")])
            runs = np.concatenate([start[open_], ~(begins | (ends - begins) << 32), np.asarray(origin.column("run"))])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hashed[open_], own, theirs]).view(np.int64)), docs_of, keys_of, pa.array(runs)], names=["hash", "doc", "key", "run"])

    windows = near.mapInArrow(run, f"hash bigint, doc {kind}, key int, run bigint")
    mine, sure, same = F.struct("doc", "run", "key"), F.col("run") < 0, Window.partitionBy("hash")
    seen = windows.withColumns({"first": F.min(F.when(~sure, mine)).over(same), "last": F.max(F.when(~sure, mine)).over(same)}).where(sure | (F.col("last") > F.col("first")))
    value = F.when(sure, F.bitwise_not("run")).otherwise(F.col("run") + F.when(mine > F.col("first"), 0).otherwise(_FIRST))
    return seen.groupBy("doc", "key").agg(F.collect_set(value).alias("runs"))


def _expand(runs: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, whether it is the first occurrence) of every repeated window, each once; a later occurrence is never a first one."""
    value = np.asarray(runs.flatten(), np.int64)
    row = np.repeat(np.arange(len(runs)), np.diff(np.asarray(runs.offsets)))
    first = value >= _FIRST
    value = value & (_FIRST - 1)
    count = (value >> 32) + 1
    start = flat_ranges(value & 0xFFFFFFFF, count)
    place = np.repeat(row, count) << 32 | start
    first = np.repeat(first, count)
    later = np.unique(place[~first])
    fresh = np.setdiff1d(place[first], later)
    every = np.concatenate([later, fresh])
    return every >> 32, every & 0xFFFFFFFF, np.arange(len(every)) >= len(later)


def _spans(runs: pa.Array, window: int, kept: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words, words after the last, row) of the maximal spans that later occurrences cover, or with ``kept`` the first ones."""
    row, begin, first = _expand(runs)
    row, begin = row[first == kept], begin[first == kept]
    head = np.ones(len(begin), bool)
    head[1:] = (row[1:] != row[:-1]) | (begin[1:] > begin[:-1] + window)
    tail = np.append(head[1:], True) if len(head) else head
    return begin[head], begin[tail] + window, row[head]


def repeated_spans(docs: DataFrame, window: int = 50, span: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, span_start, span_end, n_words, kept): the maximal spans, as word positions [start, end), of runs of ``window`` words that occur
    more than once. Where ``kept`` is false every word lies in a run that occurs earlier, in a lesser doc_id or further left in the same text; where it is true
    the runs occur here first. The two kinds may overlap.

    Words are compared as they are written; what separates them doesn't matter. Texts of fewer words than the window have no spans, nor
    have null texts; rows with a null id are left out. Rows that repeat an id and text are one document. Other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kept in (False, True):
                a, b, row = _spans(batch.column("runs"), window, kept)
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(row)), pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(b - a, pa.int32()), pa.array(np.full(len(a), kept))], names=[id_col, "span_start", "span_end", "n_words", "kept"])

    return repeated_windows(docs, window, span, id_col, text_col).select("doc", "runs").mapInArrow(run, f"{id_col} {kind}, span_start int, span_end int, n_words int, kept boolean")


def without_repeats(docs: DataFrame, window: int = 50, span: int = 8, id_col: str = "doc_id", text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with the words of repeated spans cut from their texts, and ``size_col`` set anew where a text was cut.

    A cut reaches from a span's first byte to the next word that stays; a text of which no word stays is removed with its row.
    All columns and rows without repeats stay as they are.
    """
    doc, key, spots = (unused(c, docs) for c in ("doc", "key", "runs"))
    found = repeated_windows(docs, window, span, id_col, text_col).select(F.col("doc").alias(doc), F.col("key").alias(key), F.col("runs").alias(spots))
    joined = docs.join(found, (F.col(id_col) == F.col(doc)) & (F.hash(text_col) == F.col(key)), "left").drop(doc, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            whole = part.select([c for c in part.schema.names if c != spots])
            starts = part.column(spots)
            hit = np.flatnonzero(starts.is_valid().to_numpy(zero_copy_only=False))
            if not len(hit):
                yield whole
                continue
            some = part.take(pa.array(hit))
            data, offsets = buffers(some.column(text_col))
            opens, _, per = word_bounds(data, offsets)
            a, b, row = _spans(some.column(spots), window)
            drop = np.zeros(len(data) + 1, np.int64)
            after = np.append(opens, len(data))[np.minimum(per[row] + b, len(opens))]
            after = np.minimum(after, offsets[row + 1])
            np.add.at(drop, opens[per[row] + a], 1)
            np.add.at(drop, after, -1)
            gone = np.cumsum(drop[:-1]) > 0
            left = np.diff(per) - np.bincount(row, b - a, len(hit)).astype(np.int64)
            raw, text = data[~gone], np.concatenate([[0], np.cumsum(~gone)])[offsets]
            pieces = [raw[text[k] : text[k + 1]].tobytes().decode() for k in range(len(hit))]
            column = whole.column(text_col).to_pylist()
            chars = whole.column(size_col).to_pylist() if size_col in whole.schema.names else None
            stay = np.ones(part.num_rows, bool)
            for k, i in enumerate(hit.tolist()):
                column[i] = pieces[k].rstrip(" \t\n\x0b\f\r") if after_all(b, row, k, per) else pieces[k]
                stay[i] = left[k] > 0
                if chars is not None:
                    chars[i] = len(column[i])
            out = whole.set_column(whole.schema.get_field_index(text_col), whole.schema.field(text_col), pa.array(column, whole.schema.field(text_col).type))
            if chars is not None:
                out = out.set_column(out.schema.get_field_index(size_col), out.schema.field(size_col), pa.array(chars, out.schema.field(size_col).type))
            yield out.filter(pa.array(stay))

    return joined.mapInArrow(run, docs.schema)


def after_all(ends: np.ndarray, row: np.ndarray, k: int, per: np.ndarray) -> bool:
    """Whether the last span of text k ends with the text, so that white space before it is now at the end."""
    own = ends[row == k]
    return len(own) > 0 and int(own[-1]) == int(per[k + 1] - per[k])


REPEATED_SPANS_SQL = r"""
with d as (
  select distinct doc_id, list_filter(string_split_regex(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws from documents where doc_id is not null
), p as (
  select doc_id, i, array_to_string(ws[i + 1:i + 50], ' ') as win from (select doc_id, ws, unnest(range(0, len(ws) - 49)) as i from d where len(ws) >= 50)
), again as (
  select doc_id, i, nth = 1 as kept from (select doc_id, i, row_number() over (partition by win order by doc_id, i) as nth, count(*) over (partition by win) as n from p) where n > 1
), islands as (
  select doc_id, i, kept, sum(fresh) over (partition by doc_id, kept order by i) as island
  from (select doc_id, i, kept, case when i <= lag(i) over (partition by doc_id, kept order by i) + 50 then 0 else 1 end as fresh from again)
)
select doc_id, cast(min(i) as int) as span_start, cast(max(i) + 50 as int) as span_end, cast(max(i) + 50 - min(i) as int) as n_words, kept
from islands group by doc_id, kept, island
"""
