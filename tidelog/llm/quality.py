"""Quality classifier by Bradley-Terry pairwise ranking.

A document's score is linear in its features, and P(a is preferred to b) = sigmoid(score(a) - score(b)); weights minimise the
logistic loss on feature differences of preference pairs. A labelled document is preferred when its quality is 1 and it isn't toxic, to any
that is poor or toxic. Features are a few measures of the text and the presence of hashed words and word beginnings.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._session import dropped, written
from tidelog.llm._text import U, buffers, flat_ranges, gram_hashes, mix, range_hasher, slices, word_bounds

BITS = 18
DENSE = 14
_KIND = np.zeros((4, 256), dtype=np.float64)
_KIND[0, ord("A") : ord("Z") + 1] = 1
_KIND[1, ord("0") : ord("9") + 1] = 1
_KIND[2, [c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"!?-()"]] = 1
_KIND[3, [ord(c) for c in ".,;:!?"]] = 1


def features(text: pa.Array, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense measures, hashed features that are present, their offsets); ``wanted`` marks the hashed features to look for.

    A text's features depend on that text alone, whatever texts are beside it.
    """
    raw, raw_offsets = buffers(text)
    data, offsets = buffers(pc.utf8_lower(text))
    starts, ends, per = word_bounds(data, offsets)
    hashed = range_hasher(data)
    # punctuation around a word isn't part of it
    soft = np.zeros(256, bool)
    soft[[ord(c) for c in ".,;:!?\"'()"]] = True
    for _ in range(2):
        trim = (ends - starts > 1) & soft[data[ends - 1]] if len(ends) else np.zeros(0, bool)
        ends = ends - trim
    word = hashed(starts, ends)
    size = np.diff(offsets)
    count = np.diff(per)
    n = np.maximum(count, 1)
    text_of = np.repeat(np.arange(len(count)), count)
    dense = np.zeros((len(count), DENSE))
    dense[:, 0] = 1.0
    dense[:, 1] = np.log1p(count)
    dense[:, 2] = size / n / 10
    repeat = np.zeros(len(word))
    repeat[1:] = (word[1:] == word[:-1]) & (text_of[1:] == text_of[:-1])
    dense[:, 3] = np.bincount(text_of, repeat, len(count)) / n
    for k in range(4):
        run = np.concatenate([[0], np.cumsum(_KIND[k][raw])])
        dense[:, 4 + k] = (run[raw_offsets[1:]] - run[raw_offsets[:-1]]) / np.maximum(np.diff(raw_offsets), 1)
    dense[:, 8] = np.minimum(dense[:, 4] * 5, 1)
    dense[:, 9] = np.minimum(dense[:, 3] * 20, 1)
    dense[:, 10] = np.minimum(dense[:, 6] * 50, 1)
    dense[:, 11] = np.minimum(dense[:, 7] * 50, 1)
    length = ends - starts
    dense[:, 12] = np.bincount(text_of, length == 1, len(count)) / n
    # of the runs of three words, those that occurred before in the same text
    runs, per_run = gram_hashes(word, per, 3)
    run_of = np.repeat(np.arange(len(count)), np.diff(per_run))
    fresh = np.unique(mix(runs + run_of.astype(np.uint64) * U(0x9E3779B97F4A7C15)), return_index=True)[1]
    runs_in = np.diff(per_run)
    dense[:, 13] = (runs_in - np.bincount(run_of[fresh], minlength=len(count))) / np.maximum(runs_in, 1)
    pieces = [word] + [hashed(starts, np.minimum(ends, starts + k)) for k in (4, 5, 6)]
    flat, owner = [], []
    for k, p in enumerate(pieces):
        index = ((p * U(2 * k + 0x9E3779B97F4A7C15)) >> U(64 - BITS)).astype(np.int64)
        take = np.arange(len(index)) if k == 0 else np.flatnonzero(length > 3 + k - 1)
        if wanted is not None:
            take = take[wanted[index[take]]]
        flat.append(index[take])
        owner.append(text_of[take])
    key = np.unique((np.concatenate(owner) << BITS) | np.concatenate(flat))
    return dense, key & ((1 << BITS) - 1), np.searchsorted(key >> BITS, np.arange(len(count) + 1))


@dataclass(frozen=True)
class Ranker:
    """Weights, the least score that is kept, and what held-out pairs and documents say of them."""

    dense: np.ndarray
    hashed: np.ndarray
    threshold: float
    pair_accuracy: float
    balanced_accuracy: float
    quantile: float

    @functools.cached_property
    def wanted(self) -> np.ndarray:
        return self.hashed != 0

    def score(self, text: pa.Array) -> np.ndarray:
        dense, present, per = features(text, self.wanted)
        run = np.concatenate([[0.0], np.cumsum(self.hashed[present].astype(np.float64))])
        return np.round(dense @ self.dense + run[per[1:]] - run[per[:-1]], 6)


def fit(dense: np.ndarray, present: np.ndarray, per: np.ndarray, good: np.ndarray, steps: int = 200, l1: float = 6e-4, seed: int = 7) -> Ranker:
    """Adam on the mean pair loss, with soft thresholding of the hashed weights; a fifth of the documents of each kind, at least one, is held
    out for the threshold. A kind of a single document is fitted on, and its own score bears on the threshold."""
    draw = np.random.default_rng(seed)
    chance, held, judged = draw.random(len(good)), np.zeros(len(good), bool), np.zeros(len(good), bool)
    if not good.any() or good.all():
        return Ranker(np.zeros(DENSE), np.zeros(1 << BITS, np.float32), -np.inf, 0.5, 0.5, 0.0)
    for kind in (good, ~good):
        own = np.flatnonzero(kind)
        own = own[np.argsort(chance[own], kind="stable")]
        held[own[: min(max(1, len(own) // 5), len(own) - 1)]] = True
        judged[own] = held[own] if len(own) > 1 else True
    counts = np.diff(per)
    seen = np.zeros(1 << BITS, np.int64)
    for low in range(0, len(good), 500):  # in parts, as the driver's memory is small
        rest = np.repeat(~held[low : low + 500], counts[low : low + 500])
        seen += np.bincount(present[per[low] : per[min(low + 500, len(good))]][rest], minlength=1 << BITS)
    scale = np.maximum(dense[~held].std(axis=0), 1e-9)
    scale[0] = 1.0
    names = np.flatnonzero(seen >= 3)
    rank = np.full(1 << BITS, -1, np.int32)
    rank[names] = np.arange(len(names))
    cols = rank[present]
    usable = cols >= 0
    ends = np.concatenate([[0], np.cumsum(usable, dtype=np.int64)])[per]
    cols = cols[usable].astype(np.int64)
    del usable
    counts = np.diff(ends)
    some = np.flatnonzero(counts)
    w = np.zeros(DENSE + len(names))
    x = dense / scale
    m, v = np.zeros_like(w), np.zeros_like(w)
    a, b = np.flatnonzero(good & ~held), np.flatnonzero(~good & ~held)

    # steps look at what isn't held out alone
    own = cols[np.repeat(~held, counts)]
    per_own = np.where(held, 0, counts)
    some_own, ends_own = np.flatnonzero(per_own), np.cumsum(per_own) - per_own

    def scores(some: np.ndarray, cols: np.ndarray, first: np.ndarray) -> np.ndarray:
        out = x @ w[:DENSE]
        if len(some):
            out[some] += np.add.reduceat(w[DENSE:][cols], first[some])
        return out

    for t in range(1, steps + 1):
        s = scores(some_own, own, ends_own)
        i, j = draw.choice(a, 4 * len(b) + len(a)), draw.choice(b, 4 * len(b) + len(a))
        pull = 1.0 / (1.0 + np.exp(np.clip(s[i] - s[j], -30, 30))) / len(i)
        c = np.bincount(i, pull, len(good)) - np.bincount(j, pull, len(good))
        g = -np.concatenate([c @ x, np.bincount(own, np.repeat(c, per_own), len(names))])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 / (1 + t / 60)
        pace = step / (np.sqrt(v / (1 - 0.99**t)) + 1e-5)
        w -= pace * (m / (1 - 0.9**t))
        w[DENSE:] = np.sign(w[DENSE:]) * np.maximum(np.abs(w[DENSE:]) - pace[DENSE:] * l1, 0)
    s = scores(some, cols, ends)
    g, p = np.sort(s[good & judged]), np.sort(s[~good & judged])
    pairs = np.searchsorted(p, g).mean() / len(p)
    # the quantile of held-out scores that parts the two kinds best
    levels = np.arange(0.0, 1.0, 0.0025)
    cut = np.quantile(s[judged], levels)
    balanced = (np.searchsorted(p, cut) / len(p) + 1 - np.searchsorted(g, cut) / len(g)) / 2
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    pick = best[len(best) // 2]
    hashed = np.zeros(1 << BITS, np.float32)
    hashed[names] = w[DENSE:]
    return Ranker(w[:DENSE] / scale, hashed, float(cut[pick]), float(pairs), float(balanced[pick]), float(levels[pick]))


def _blocks(common: int, rare: int, most: int) -> tuple[int, int]:
    """(parts, blocks of the rarer kind): part p is block p of the commoner kind and block p modulo their number of the rarer one. A part has about ``most``
    documents, an eighth of them of the rarer kind, which goes into several parts if it is too rare for that, and into all of them if it is rarer still."""
    if rare * 8 >= common + rare:
        parts = max(1, -(-(common + rare) // most))
        return parts, parts
    blocks = max(1, -(-rare // max(1, most // 8)))
    return max(blocks, -(-common // max(1, most - min(rare, max(1, most // 8))))), blocks


def _packed(present: np.ndarray, per: np.ndarray) -> pa.Array:
    """A text's sorted features in two bytes each: how many there are of each value of the bits above 16, then the bits below."""
    high = 1 << BITS - 16
    n, owner = len(per) - 1, np.repeat(np.arange(len(per) - 1), np.diff(per))
    head = np.bincount(owner * high + (present >> 16), minlength=n * high).astype(np.uint32).view(np.uint16).reshape(n, 2 * high)
    ends = np.arange(n + 1) * 2 * high + per
    out = np.zeros(ends[-1], np.uint16)
    out[flat_ranges(ends[:-1], np.full(n, 2 * high))] = head.ravel()
    out[flat_ranges(ends[:-1] + 2 * high, np.diff(per))] = present & 0xFFFF
    return pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(out)])


def _unpacked(part: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(dense, present, offsets) of rows whose features are packed."""
    high = 1 << BITS - 16
    dense = np.frombuffer(b"".join(part.column("dense").to_pylist()), np.float64).reshape(-1, DENSE)
    size = np.asarray(pc.binary_length(part.column("present")), np.int64) // 2 - 2 * high
    per = np.concatenate([[0], np.cumsum(size)])
    flat, tops = np.zeros(per[-1], np.uint32), np.arange(high, dtype=np.uint32) << 16
    for k, b in enumerate(part.column("present")):
        raw = np.frombuffer(b.as_py(), np.uint16)
        flat[per[k] : per[k + 1]] = np.repeat(tops, raw[: 2 * high].view(np.uint32)) | raw[2 * high :]
    return dense, flat, per


def _threshold(judged: DataFrame) -> tuple[float, float, float]:
    """(cut, balanced accuracy, quantile) of all rows (score, good): the quantile of the scores that parts the two kinds best."""
    levels = np.arange(0.0, 1.0, 0.0025)
    cut = np.array(judged.agg(F.percentile("score", F.lit(levels.tolist()))).first()[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(2 * (len(cut) + 1), np.int64)
        for part in batches:
            # how many cuts a row reaches
            reached = np.searchsorted(cut, np.asarray(part.column("score")), side="right")
            counts += np.bincount(2 * reached + np.asarray(part.column("good")).astype(np.int64), minlength=len(counts))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["place", "n"])

    counts = np.zeros(2 * (len(cut) + 1))
    for r in judged.mapInArrow(run, "place bigint, n bigint").groupBy("place").agg(F.sum("n").alias("n")).collect():
        counts[r.place] = r.n
    below = np.cumsum(counts.reshape(-1, 2), axis=0)
    poor, good = below[-1]
    balanced = (below[:-1, 0] / poor + 1 - below[:-1, 1] / good) / 2
    best = np.flatnonzero(balanced >= balanced.max() - 1e-12)
    pick = best[len(best) // 2]
    return float(cut[pick]), float(balanced[pick]), float(levels[pick])


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 12_000, id_col: str = "doc_id", text_col: str = "text") -> Ranker:
    """A ranker of all labelled documents. They are fitted in parts of about ``most_labelled``, by their hashed ids, and the weights are the mean of the
    parts'. An eighth of a part is of either kind, where there are as many; of a kind that is rarer, documents are in several parts. The threshold is the
    quantile of the scores of all labelled documents that parts the two kinds best; the pair accuracy is the mean of the parts' on what each holds out.

    A label without an id or quality is left out; of several labels of an id the worst counts, and of several texts of an id the least, so
    the fit depends on nothing but the tables. Null texts are left out, empty ones have the features of no word,
    and very long ones are read whole. Other columns are ignored.
    """
    good = ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).alias("__good")
    known = labels.where(F.col(id_col).isNotNull() & F.col("quality").isNotNull()).select(F.col(id_col).alias("__id"), good).groupBy("__id").agg(F.min("__good").alias("__good"))
    known = written(known, "labelled")  # so Spark knows its size before it would shuffle texts
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(known, F.col("id") == F.col("__id")).groupBy("id").agg(F.min("text").alias("text"), F.first("__good").alias("good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            dense, present, per = features(part.column("text"))
            wide = pa.BinaryArray.from_buffers(pa.binary(), len(dense), [None, pa.py_buffer(np.arange(len(dense) + 1, dtype=np.int32) * (8 * DENSE)), pa.py_buffer(np.ascontiguousarray(dense))])
            spot = _packed(present, per)
            yield pa.RecordBatch.from_arrays([part.column("id").cast(pa.string()), part.column("good"), wide, spot], names=["id", "good", "dense", "present"])

    def one(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        own = np.asarray(group.column("good")).astype(bool)
        ranker = fit(*_unpacked(group), own)
        names = np.flatnonzero(ranker.hashed)
        packed = [ranker.dense.tobytes(), names.astype(np.uint32).tobytes(), ranker.hashed[names].tobytes()]
        return pa.table({"part": group.column("part")[:1], "both": [bool(own.any() and not own.all())], "pairs": [ranker.pair_accuracy]} | {k: pa.array([v], pa.binary()) for k, v in zip(("dense", "names", "weights"), packed)})

    table = written(rows.mapInArrow(run, "id string, good boolean, dense binary, present binary"), "features")
    dropped(known)
    size = {r.good: r["count"] for r in table.groupBy("good").count().collect()}
    if len(size) < 2:
        dropped(table)
        return fit(np.zeros((0, DENSE)), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool))
    rarer = size[True] < size[False]
    parts, blocks = _blocks(size[not rarer], size[rarer], most_labelled)
    block = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    several = F.when(F.col("good") == rarer, F.sequence(block(blocks), F.lit(parts - 1), F.lit(blocks))).otherwise(F.array(block(parts)))
    made = table.withColumn("part", F.explode(several)).groupBy("part").applyInArrow(one, "part int, both boolean, pairs double, dense binary, names binary, weights binary")
    # one part at a time, in order, so that the sums are always the same
    dense, hashed, pairs, count = np.zeros(DENSE), np.zeros(1 << BITS), 0.0, 0
    for r in made.where("both").orderBy("part").toLocalIterator():
        dense += np.frombuffer(r.dense, np.float64)
        hashed[np.frombuffer(r.names, np.uint32)] += np.frombuffer(r.weights, np.float32)
        pairs, count = pairs + r.pairs, count + 1
    dense, hashed = dense / max(count, 1), (hashed / max(count, 1)).astype(np.float32)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            wide, present, per = _unpacked(part)
            total = np.concatenate([[0.0], np.cumsum(hashed[present].astype(np.float64))])
            yield pa.RecordBatch.from_arrays([pa.array(np.round(wide @ dense + total[per[1:]] - total[per[:-1]], 6)), part.column("good")], names=["score", "good"])

    judged = written(table.mapInArrow(judge, "score double, good boolean"), "judged")
    dropped(table)
    cut, balanced, quantile = _threshold(judged)
    dropped(judged)
    return Ranker(dense, hashed, cut, pairs / max(count, 1), balanced, quantile)


def scored(docs: DataFrame, ranker: Ranker, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, keep) of every row, in one narrow pass. A null text has a null score and isn't kept; other columns are ignored."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, score double, keep boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            text = part.column(text_col)
            score = ranker.score(text)
            gone = text.is_null().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([part.column(id_col), pa.array(score, mask=gone), pa.array((score >= ranker.threshold) & ~gone)], names=[id_col, "score", "keep"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def kept(docs: DataFrame, ranker: Ranker, text_col: str = "text") -> DataFrame:
    """The rows whose score reaches the threshold, with all their columns; rows with a null text go. A score right at the threshold stays, repeated rows
    each get the verdict of their text, and an empty text that of no word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col):
            text = part.column(text_col)
            yield part.filter(pc.and_(pa.array(ranker.score(text) >= ranker.threshold), text.is_valid()))

    return docs.mapInArrow(run, docs.schema)


def classify(docs: DataFrame, labels: DataFrame, most_labelled: int = 12_000) -> DataFrame:
    """(doc_id, score, keep) of every document by a ranker trained on the labelled ones. Without documents of both kinds no pair
    exists, all weights are zero and every document that has a text is kept. Repeated rows and null ids each have their row."""
    return scored(docs, train(docs, labels, most_labelled))
