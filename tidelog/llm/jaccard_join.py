"""N-gram Jaccard self-join by MinHash banding, verified on the full n-gram sets, and classes of near copies.

Texts with equal sets of n-grams are one class, and classes are what is joined. One pass writes each text's class, band hashes and a sketch of two bits for
each of the hash values behind the bands. Classes that share a band hash meet in a bucket, where the sketches tell chance from likeness: a pair
whose sketches agree in too few places is dropped there, before anything is closed transitively. What is left connects small sets of classes that
are nearly all alike; every pair of such a set is compared on its whole n-gram sets by products of incidence matrices, in blocks where there are many.

A batch that has many near copies of one class in a bucket ties them to it in a bucket of their own and sends the others on, so a
text of which there are millions of near copies fills no bucket. What was tied elsewhere still meets the rest of the bucket it left: where a bucket
isn't connected as a whole once all links are closed, its members that aren't connected to the first one meet all others, in blocks. Nothing is capped:
large buckets and large sets take more blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelog.llm._components import components
from tidelog.llm._session import dropped, unused, written
from tidelog.llm._text import PUNCTUATION, U, buffers, flat_ranges, gram_hashes, lists, mix, slices, word_hashes

BLOCK, MANY, FEW, MEET = 1024, 16, 64, 8192
_PLACES = U(0x5555555555555555)


def bands_for(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """(bands, rows): the most rows a band, thus the fewest false candidates, with which a pair right at the threshold is found with
    probability ``recall`` and no more than ``most_hashes`` are needed; bands of one row take as many as they need."""
    for rows in range(16, 0, -1):
        p = threshold**rows
        bands = 1 if p >= recall else int(np.ceil(np.log1p(-recall) / np.log1p(-p)))
        if bands * rows <= most_hashes:
            break
    return bands, rows


def least_agreement(threshold: float, recall: float, hashes: int) -> int:
    """In how many of its places a sketch of a pair right at the threshold agrees with probability ``recall`` at least."""
    p = threshold + (1 - threshold) / 4
    return int(np.floor(hashes * p - NormalDist().inv_cdf(recall) * np.sqrt(hashes * p * (1 - p))))


def signatures(grams: np.ndarray, offsets: np.ndarray, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, band hashes, sketch) of the texts that have grams, in order. They depend on a text's set of grams alone."""
    draw = np.random.default_rng(0xBA2D)
    some, hashes = offsets[:-1][np.diff(offsets) > 0], bands * rows
    out, sketch = np.zeros((len(some), bands), np.uint64), np.zeros((len(some), -(-hashes // 32)), np.uint64)
    if not len(some):
        return np.zeros(0, np.uint64), out, sketch
    flips = draw.integers(0, 2**63, hashes, dtype=np.uint64)
    factors = draw.integers(0, 2**63, hashes, dtype=np.uint64) | U(1)
    for k in range(hashes):
        least = mix(np.minimum.reduceat((grams ^ flips[k]) * factors[k], some) + U(k))
        out[:, k // rows] += least
        sketch[:, k // 32] |= (least >> U(62)) << U(2 * (k % 32))
    owner = np.repeat(np.arange(len(some)), np.diff(offsets)[np.diff(offsets) > 0])
    order = np.lexsort((grams, owner))
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[order][1:] != grams[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    order = order[fresh]
    sums = np.add.reduceat(mix(grams[order] + U(0x6C62272E07BB0142)), np.searchsorted(owner[order], np.arange(len(some))))
    return mix(sums), mix(out), sketch


def _grams(text: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of lower-case words without ASCII punctuation, which near copies move about, and offsets."""
    data, offsets = buffers(pc.utf8_lower(text))
    keep = ~PUNCTUATION[data]
    words, per = word_hashes(data[keep], np.concatenate([[0], np.cumsum(keep)])[offsets])
    return gram_hashes(words, per, n)


def _binary(rows: np.ndarray) -> pa.Array:
    """Each row's bytes."""
    width = rows.shape[1] * rows.itemsize
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(np.ascontiguousarray(rows))])


def _words_of(column: pa.Array, width: int) -> np.ndarray:
    """The 64-bit words of each row of a binary column."""
    _, ends, data = column.buffers()
    first, last = np.frombuffer(ends, np.int32)[[column.offset, column.offset + len(column)]]
    return np.frombuffer(data, np.uint8)[first:last].view(np.uint64).reshape(len(column), width) if len(column) else np.zeros((0, width), np.uint64)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """In how many places two sketches differ."""
    x = a ^ b
    return np.bitwise_count((x | (x >> U(1))) & _PLACES).astype(np.int64).sum(axis=-1)


def signed(docs: DataFrame, n: int, bands: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """(doc, key, cls, bands, sketch) of every row with an id, as a written table; ``key`` hashes the text as it is, and a text without
    words has no class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            grams, offsets = _grams(part.column("text"), n)
            cls, keys, sketch = signatures(grams, offsets, bands, rows)
            at = np.flatnonzero(np.diff(offsets) > 0)
            row = np.full(part.num_rows, -1, np.int64)
            row[at] = np.arange(len(at))
            none = row < 0
            take = pa.array(row, mask=none)
            yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("key"), pa.array(cls.view(np.int64)).take(take), _binary(keys).take(take), _binary(sketch).take(take)], names=["doc", "key", "cls", "bands", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows_ = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("key"), F.col(text_col).alias("text"))
    return written(rows_.mapInArrow(run, f"doc {kind}, key bigint, cls bigint, bands binary, sketch binary"), "signatures")


def _runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first place, length) of the runs of equal keys."""
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return at, np.diff(np.append(at, len(key)))


def _entries(bands: int, width: int, most: int):
    """Each batch's entries (bucket, cls, gone). Of more than MANY classes that are alike to the least one of their bucket, the others go with that one
    to a bucket of the batch's own instead; ``gone`` lists the buckets that such a class left."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, first = np.unique(np.asarray(batch.column("cls"), np.int64), return_index=True)
            if not len(cls):
                continue
            keys, sketch = _words_of(batch.column("bands"), bands)[first], _words_of(batch.column("sketch"), width)[first]
            key, owner = keys.ravel(), np.repeat(np.arange(len(cls)), bands)
            by = np.argsort(key, kind="stable")  # owners stay in order, so a run begins with the least class
            key, owner = key[by], owner[by]
            at, size = _runs(key)
            stay, ties, left = np.ones(len(key), bool), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            big = np.flatnonzero(size > MANY + 1)
            if len(big):
                place = flat_ranges(at[big], size[big])
                leader = owner[np.repeat(at[big], size[big])]
                alike = (_apart(sketch[owner[place]], sketch[leader]) <= most) & (owner[place] != leader)
                nth = np.cumsum(alike) - np.repeat((np.cumsum(alike) - alike)[np.cumsum(size[big]) - size[big]], size[big])
                gone = alike & (nth > MANY)
                stay[place[gone]] = False
                ties = leader[gone] * len(cls) + owner[place[gone]]
                by = np.argsort(ties, kind="stable")
                ties, left = ties[by], key[place[gone]][by]
            first, count = _runs(ties)
            ties = ties[first]
            a, b = ties // len(cls), ties % len(cls)
            own = mix(cls[a].view(np.uint64) + mix(np.full(len(a), U(len(cls)) + keys.sum(dtype=np.uint64), np.uint64)))
            head = np.unique(a, return_index=True)[1]
            out = np.concatenate([key[stay], own[head], own])
            ends = np.concatenate([np.zeros(len(out) - len(b) + 1, np.int64), np.cumsum(count)])
            yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), pa.array(cls[np.concatenate([owner[stay], a[head], b])]), lists(left.view(np.int64), ends, pa.int64())], names=["bucket", "cls", "gone"])

    return run


def _meet(cls: np.ndarray, sketch: np.ndarray, at: np.ndarray, size: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b), as places, that connect what the alike pairs of each bucket connect; a bucket is a run of rows."""
    leader = np.repeat(at, size)
    near = _apart(sketch, sketch[leader]) <= most
    rows = np.arange(len(cls))
    star = near & (rows != leader)
    a, b = [leader[star]], [rows[star]]
    # what isn't like its leader meets all others of its bucket
    rest = size - np.add.reduceat(near.astype(np.int64), at)
    for low in range(0, len(at), 4096):
        some = np.arange(low, min(low + 4096, len(at)))
        some = some[(rest[some] > 0) & (size[some] > 2) & (size[some] <= FEW)]
        if len(some):
            member = flat_ranges(at[some], size[some])
            odd = member[~near[member]]
            bucket_of = np.repeat(some, size[some])[~near[member]]
            x = np.repeat(odd, size[bucket_of])
            y = flat_ranges(at[bucket_of], size[bucket_of])
            take = (x != y) & (near[y] | (x < y))
            x, y = x[take], y[take]
            good = _apart(sketch[x], sketch[y]) <= most
            a.append(np.minimum(x, y)[good])
            b.append(np.maximum(x, y)[good])
    for k in np.flatnonzero((rest > 0) & (size > FEW)).tolist():
        # in blocks, farthest from the leader first; two rows are no nearer to each other than their distances from the leader differ
        far = _apart(sketch[at[k] : at[k] + size[k]], sketch[at[k]])
        by = np.argsort(-far, kind="stable")
        far, member = far[by], at[k] + by
        for low in range(0, int(rest[k]), BLOCK):
            block = member[low : min(low + BLOCK, int(rest[k]))]
            reach = int(np.searchsorted(-far, most - far[low + len(block) - 1], side="right"))
            for h in range(low, reach, BLOCK):
                other = member[h : min(h + BLOCK, reach)]
                i, j = np.nonzero(_apart(sketch[block][:, None], sketch[other][None]) <= most)
                both = np.unique(np.concatenate([block, other]))
                i, j = _forest(np.searchsorted(both, block[i]), np.searchsorted(both, other[j]), len(both))
                a.append(both[i])
                b.append(both[j])
    return np.concatenate(a), np.concatenate(b)


def _forest(x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (least, other) that connect the same of 0..n-1 as the links (x, y) do."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[x], root[y])
        now = root.copy()
        np.minimum.at(now, root[x], low)
        np.minimum.at(now, root[y], low)
        now = now[now]
        if (now == root).all():
            break
        root = now
    other = np.flatnonzero(root != np.arange(n))
    return root[other], other


def _linked(width: int, most: int):
    """The links of rows (bucket, cls, sketch) that come in order of buckets; a bucket is read whole before it is looked at."""

    def look(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        bucket, cls = np.asarray(rows.column("bucket"), np.int64), np.asarray(rows.column("cls"), np.int64)
        sketch = _words_of(rows.column("sketch").combine_chunks(), width)
        a, b = _meet(cls, sketch, *_runs(bucket), most) if len(cls) else (np.zeros(0, np.int64),) * 2
        pair = np.unique(np.stack([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket = np.asarray(batch.column("bucket"), np.int64)
            cut = int(_runs(bucket)[0][-1])
            if waiting and bucket[0] != waiting[-1].column("bucket")[-1].as_py():
                yield look(pa.Table.from_batches(waiting))
                waiting = []
            if cut:
                yield look(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
                waiting = []
            waiting.append(batch.slice(cut))
        if waiting:
            yield look(pa.Table.from_batches(waiting))

    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many grams each two sets share."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    take = df[column] > 1
    owner, column = owner[take], np.unique(column[take], return_inverse=True)[1]
    out = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
        i, j = np.searchsorted(column, (low, low + 2048))
        m = np.zeros((len(sets), int(column[j - 1]) - low + 1), np.float32)
        m[owner[i:j], column[i:j] - low] = 1
        out += m @ m.T
    return out.astype(np.int64)


class Join:
    """What the searches share: signatures, classes, the likely links and the verified ones."""

    def __init__(self, docs: DataFrame, threshold: float, n: int, recall: float, id_col: str, text_col: str, most_hashes: int = 256):
        # one half of the allowed loss is the bands', one the sketch's
        each = 1 - (1 - recall) / 2
        bands, rows = bands_for(threshold, each, most_hashes)
        self.docs, self.threshold, self.n, self.id_col, self.text_col = docs, threshold, n, id_col, text_col
        self.width, self.most = -(-bands * rows // 32), bands * rows - least_agreement(threshold, each, bands * rows)
        self.bands = bands
        self.kind = docs.schema[id_col].dataType.simpleString()
        self.signed = signed(docs, n, bands, rows, id_col, text_col)
        #: (cls, doc, key): a document of a class, with the least key of its texts
        self.members = self.signed.where("cls is not null").groupBy("cls", "doc").agg(F.min("key").alias("key"), F.min("sketch").alias("sketch"))
        #: (cls, size, rep, sketch): how many documents a class has, and the least of them
        self.classes = written(self.members.groupBy("cls").agg(F.count("*").alias("size"), F.min(F.struct("doc", "key")).alias("rep"), F.min("sketch").alias("sketch")), "classes")

    def likely(self) -> DataFrame:
        """(a, b): classes that share a bucket and have like sketches, as many pairs as keep connected what they connect."""
        known = self.signed.where("cls is not null").select("cls", "bands", "sketch")
        entries = written(known.mapInArrow(_entries(self.bands, self.width, self.most), "bucket bigint, cls bigint, gone array<bigint>"), "entries")
        own = Window.partitionBy("bucket")
        shared = entries.select("bucket", "cls").repartition("bucket").dropDuplicates(["bucket", "cls"]).withColumn("some", F.min("cls").over(own) < F.max("cls").over(own)).where("some").drop("some")
        links = written(self._met(shared.withColumn("odd", F.lit(False))), "likely")
        gone = entries.where("size(gone) > 0").select(F.explode("gone").alias("bucket"), "cls")
        if not gone.limit(1).count():
            dropped(entries)
            return links
        # the whole of each bucket that a class left; where all of it is connected by now, nothing is left to find
        root = written(components(links), "roots")
        whole = entries.select("bucket", "cls").join(gone.select("bucket").distinct(), "bucket", "left_semi").unionByName(gone).distinct()
        rooted = whole.join(root, F.col("cls") == F.col("node"), "left").select("bucket", "cls", F.coalesce("root", "cls").alias("root"))
        odd = rooted.withColumn("odd", F.col("root") != F.min(F.struct("cls", "root")).over(own)["root"])
        opened = written(odd.withColumns({"size": F.count("*").over(own), "odds": F.count_if("odd").over(own)}).where("odds > 0"), "opened")
        dropped(entries)
        # a block of the odd ones meets each block of the bucket
        turns, blocks = (F.ceil(F.col(c) / MEET).cast("int") for c in ("odds", "size"))
        turn, block = F.pmod(F.xxhash64("cls", F.lit(1)), turns), F.pmod(F.xxhash64("cls"), blocks)
        read = F.transform(F.sequence(F.lit(0), turns - 1), lambda k: F.xxhash64("bucket", k.cast("bigint"), block.cast("bigint")))
        meets = F.transform(F.sequence(F.lit(0), blocks - 1), lambda k: F.xxhash64("bucket", turn.cast("bigint"), k.cast("bigint")))
        spots = opened.select(F.explode(F.array_distinct(F.when(F.col("odd"), F.concat(read, meets)).otherwise(read))).alias("bucket"), "cls", "odd")
        return root.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(self._met(spots)).distinct()

    def _met(self, entries: DataFrame) -> DataFrame:
        """(a, b): links of entries (bucket, cls, odd) that connect what the alike pairs of each bucket do."""
        met = entries.join(self.classes.select("cls", "sketch"), "cls").select("bucket", "cls", "odd", "sketch")
        return met.repartition("bucket").sortWithinPartitions("bucket", "odd", "cls").mapInArrow(_linked(self.width, self.most), "a bigint, b bigint").distinct()

    def compared(self, pairs: bool) -> DataFrame:
        """Of the pairs of classes that reach the threshold: (a, b, value) each with its similarity where ``pairs``; else a row (cls, null, documents
        linked) for each class and block, and rows (a, b, null) that keep connected what the pairs connect."""
        threshold, n = self.threshold, self.n
        linked = components(self.likely())
        sized = linked.withColumn("blocks", F.ceil(F.count("*").over(Window.partitionBy("root")) / BLOCK).cast("int"))
        of = sized.join(self.classes, F.col("node") == F.col("cls")).select(F.col("rep.doc").alias("__doc"), F.col("rep.key").alias("__key"), "cls", "size", "root", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int").alias("block"), "blocks")
        rows = self.docs.select(F.col(self.id_col).alias("doc"), F.xxhash64(self.text_col).alias("key"), F.col(self.text_col).alias("text"))
        texts = rows.join(of, (F.col("doc") == F.col("__doc")) & (F.col("key") == F.col("__key"))).select("text", "cls", "size", "root", "block", "blocks")

        def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in slices(batches, "text"):
                grams, offsets = _grams(part.column("text"), n)
                own, blocks = np.asarray(part.column("block")), np.asarray(part.column("blocks"))
                sets = [np.unique(grams[offsets[k] : offsets[k + 1]]).tobytes() for k in range(part.num_rows)]
                row = np.repeat(np.arange(part.num_rows), blocks)
                other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                i, j = np.minimum(own[row], other), np.maximum(own[row], other)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([part.column("root").take(at), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(own[row], pa.int32()), part.column("cls").take(at), part.column("size").take(at), pa.array([sets[k] for k in row], pa.binary())], names=["root", "i", "j", "block", "cls", "size", "grams"])

        def compare(group: pa.Table) -> pa.Table:
            cross = group.column("i")[0].as_py() != group.column("j")[0].as_py()
            # rows that repeat an id and text are one
            cls, first = np.unique(np.asarray(group.column("cls"), np.int64), return_index=True)
            group = group.take(pa.array(first))
            block, size = np.asarray(group.column("block")), np.asarray(group.column("size"), np.int64)
            sets = [np.frombuffer(g, np.uint64) for g in group.column("grams").to_pylist()]
            count = np.array([len(s) for s in sets])
            both = _overlaps(sets) if len(sets) > 1 else np.zeros((1, 1), np.int64)
            x, y = np.nonzero(np.triu(both, 1))
            value = both[x, y] / (count[x] + count[y] - both[x, y])
            good = (value >= threshold) & ((block[x] != block[y]) | (not cross))
            x, y, value = x[good], y[good], value[good]
            if pairs:
                return pa.table({"a": pa.array(cls[x]), "b": pa.array(cls[y]), "value": pa.array(value)})
            links = np.bincount(x, size[y], len(cls)) + np.bincount(y, size[x], len(cls))
            some = np.flatnonzero(links)
            i, j = _forest(x, y, len(cls))
            return pa.table({"a": pa.array(np.concatenate([cls[some], cls[i]])), "b": pa.array(np.concatenate([cls[some], cls[j]]), mask=np.arange(len(some) + len(i)) < len(some)), "value": pa.array(np.concatenate([links[some], np.zeros(len(i))]).astype(np.float64))})

        return texts.mapInArrow(gather, "root bigint, i int, j int, block int, cls bigint, size bigint, grams binary").groupBy("root", "i", "j").applyInArrow(compare, "a bigint, b bigint, value double")

    def known(self) -> tuple[DataFrame, DataFrame]:
        """((cls, class_rep, class_id, links) of every class: the least document of all that it is connected to, and the number of documents other than
        itself that a document of it is linked to), (cls, doc, key)."""
        found = written(self.compared(pairs=False), "links")
        root = components(found.where("b is not null").select("a", "b"))
        links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("value").cast("bigint").alias("more"))
        least = root.join(self.classes, F.col("node") == F.col("cls")).groupBy("root").agg(F.min("rep").alias("least"))
        connected = root.join(least, "root").select(F.col("node").alias("cls"), "least")
        every = self.classes.join(connected, "cls", "left").join(links, "cls", "left")
        return every.select("cls", F.coalesce("least", "rep").alias("class_rep"), (F.col("size") - 1 + F.coalesce("more", F.lit(0))).alias("links")), self.members.select("cls", "doc", "key")


def similar_classes(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_links): for every document the least id of all that similar pairs connect it to, and how many documents it is similar to.

    A pair is similar where the sets of word n-grams have at least that Jaccard similarity. Words are lower-case and without ASCII punctuation; one of punctuation
    alone is none. Links are exact; a pair right at the threshold is found with probability ``recall``, a closer one more surely.
    A text of fewer than n words is one gram; null texts and those without words are alone. Null ids are left out. Rows that repeat an id and
    a set of grams are one document; an id with several sets is several, each with a row. Other columns are ignored, and an empty table gives no rows.
    """
    join = Join(docs, threshold, n, recall, id_col, text_col)
    classes, members = join.known()
    alone = join.signed.where("cls is null").select(F.col("doc").alias(id_col), F.col("doc").alias("class_id"), F.lit(0).cast("bigint").alias("n_links")).distinct()
    return members.join(classes, "cls").select(F.col("doc").alias(id_col), F.col("class_rep.doc").alias("class_id"), F.col("links").alias("n_links")).unionByName(alone)


def class_pairs(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """((doc_a, doc_b, jaccard), (doc_id, rep)): the similar pairs of classes of equal sets, by their least documents, and every document's class.
    Together they hold every similar pair; documents are as in ``similar_classes``."""
    join = Join(docs, threshold, n, recall, id_col, text_col)
    rep = join.classes.select("cls", F.col("rep.doc").alias("rep"))
    a, b = (rep.select(F.col("cls").alias(c), F.col("rep").alias(r)) for c, r in (("a", "ra"), ("b", "rb")))
    pairs = join.compared(pairs=True).join(a, "a").join(b, "b").select(F.least("ra", "rb").alias("doc_a"), F.greatest("ra", "rb").alias("doc_b"), F.col("value").alias("jaccard"))
    return pairs, join.members.join(rep, "cls").select(F.col("doc").alias(id_col), "rep")


def without_copies(docs: DataFrame, threshold: float = 0.5, n: int = 3, recall: float = 0.999, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which no similar one, directly or through others, has a lesser id; all columns stay, and rows with a null id.

    Of rows that repeat an id and text one stays, the least by its JSON; of several similar texts of one id the one with the least hash.
    """
    join = Join(docs, threshold, n, recall, id_col, text_col)
    classes, _ = join.known()
    every = join.signed.groupBy("doc", "key").agg(F.first("cls").alias("cls"), F.count("*").alias("rows"))
    marked = every.join(classes, "cls", "left").select("doc", "key", "rows", (F.struct("doc", "key") > F.col("class_rep")).alias("gone"))
    doc, key, mark = (unused(c, docs) for c in ("doc", "key", "mark"))
    marks = marked.where("gone or rows > 1").select(F.col("doc").alias(doc), F.col("key").alias(key), F.coalesce("gone", F.lit(False)).alias(mark))
    joined = docs.join(marks, (F.col(id_col) == F.col(doc)) & (F.xxhash64(text_col) == F.col(key)), "left")
    once = joined.where(F.col(mark).isNull()).select(*docs.columns)
    if not every.where("rows > 1").limit(1).count():
        return once
    row = F.struct(*docs.columns)
    again = joined.where(~F.col(mark)).groupBy(doc, key).agg(F.min_by(row, F.to_json(row)).alias(mark)).select(f"{mark}.*")
    return once.unionByName(again)


SIMILAR_CLASSES_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(regexp_replace(lower(text), '[!-/:-@\[-`{-~]', '', 'g'), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as ws from documents where doc_id is not null
), g as (
  select distinct doc_id, unnest(case when len(ws) < 3 then [array_to_string(ws, ' ')]
    else list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')) end) as gram
  from w where len(ws) > 0
), n as (select doc_id, count(*) as n from g group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as shared from g a join g b on a.gram = b.gram and a.doc_id <> b.doc_id group by all),
link as (select a, b from p join n x on a = x.doc_id join n y on b = y.doc_id where shared / (x.n + y.n - shared) >= 0.5),
reach as (select distinct doc_id as a, doc_id as b from documents where doc_id is not null union select r.a, l.b from reach r join link l on r.b = l.a)
select r.a as doc_id, min(r.b) as class_id, coalesce(max(k.links), 0) as n_links
from reach r left join (select a, count(*) as links from link group by a) k on k.a = r.a group by r.a
"""
