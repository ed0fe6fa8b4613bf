"""Language-model scoring by deleted interpolation of word 1-, 2- and 3-grams.

Maximum-likelihood estimates of the three orders and the uniform one are mixed with weights that depend on how often the context
was seen; expectation-maximisation learns the weights on documents held out from counting. A counted document is scored without
the occurrence at hand (counts less one), so it isn't praised for being in the corpus.

Counting is a shuffle of blocks: a chunk of documents sends each different n-gram once, as sorted keys of 64 bits (62 of hash, 2 for the order), difference-coded and
compressed, to the bucket that owns the key's range; the bucket adds up all chunks and answers each with a block of counts in the order of
its keys. Nothing is sampled, capped or gathered on the driver but the sums, and a histogram of held-out probabilities on a fixed grid.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._session import written
from tidelog.llm._text import U, buffers, flat_ranges, mix, slices, word_hashes

CHUNK = 5 << 20
BEGIN, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
LEVELS, STEP, NEVER = 20, 2, 255
START = np.array([0.25, 0.25, 0.25, 0.25])


def keys_of(words: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(1-gram, 2-gram, 3-gram keys of every prediction, offsets): each word and an end mark is predicted from the two before it."""
    count = np.diff(per)
    offsets = per + np.arange(len(per))
    w = np.full(int(offsets[-1]), END, np.uint64)
    w[flat_ranges(offsets[:-1], count)] = words
    head = np.zeros(len(w), bool)
    head[offsets[:-1]] = True
    v = np.empty_like(w)
    v[1:] = w[:-1]
    v[head] = BEGIN
    u = np.empty_like(w)
    u[1:] = v[:-1]
    u[head] = BEGIN
    pack = lambda x, order: (x & ~U(3)) | U(order)
    two = v * U(0xD6E8FEB86659FD93) + w
    return pack(mix(w + U(1)), 1), pack(mix(two + U(2)), 2), pack(mix(mix(two) + u * U(0xA3B195354A39B70D)), 3), offsets


END_KEY = int((mix(np.array([END]) + U(1)) & ~U(3) | U(1))[0])


def squeeze(values: np.ndarray, width: int) -> bytes:
    """Whole numbers as byte planes, compressed."""
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return pa.compress(np.ascontiguousarray(planes.T).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(blob: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(blob, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view("<u8").ravel().astype(np.uint64)


def _keys_out(keys: np.ndarray) -> bytes:
    return squeeze(np.diff(keys, prepend=U(0)), 8)


def _keys_in(blob: bytes, n: int) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, n, 8), dtype=np.uint64)


class Chunk:
    """Some documents together, all held out or all counted."""

    def __init__(self, ids: pa.Array, text: pa.Array, held: bool):
        self.ids, self.text, self.held = ids, text, held
        self.live = text.is_valid().to_numpy(zero_copy_only=False)
        self.one, self.two, self.three, self.offsets = keys_of(*word_hashes(*buffers(text.filter(pa.array(self.live)))))

    def keys(self, inverse: bool = False):
        """Different keys in order, and how often each occurs, or where each prediction's are."""
        every = np.concatenate([self.one, self.two, self.three])
        if inverse:
            return np.unique(every, return_inverse=True)
        every.sort()
        first = np.ones(len(every), bool)
        first[1:] = every[1:] != every[:-1]
        at = np.flatnonzero(first)
        return every[at], np.diff(np.append(at, len(every)))

    def counts(self, total: np.ndarray, where: np.ndarray, documents: int) -> tuple[np.ndarray, ...]:
        """(c(uvw), c(uv), c(vw), c(v), c(w)) of each prediction, less one where this chunk was counted."""
        one, two, three = total[where].astype(np.int64).reshape(3, -1)
        head = self.offsets[:-1]
        uv, v = np.empty_like(two), np.empty_like(one)
        uv[1:], v[1:] = two[:-1], one[:-1]
        uv[head] = v[head] = documents
        less = 0 if self.held else 1
        return tuple(np.maximum(c - less, 0) for c in (three, uv, two, v, one))


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Chunk]]:
    """Documents of (id, text, held) batches in chunks, each with a number that two readings of the same partition agree on."""
    from pyspark import TaskContext

    part, ordinal = TaskContext.get().partitionId(), 0
    waiting: dict[bool, list] = {True: [], False: []}
    size = {True: 0, False: 0}

    def close(held: bool) -> tuple[int, Chunk]:
        nonlocal ordinal
        rows = pa.Table.from_batches(waiting[held]).combine_chunks()
        waiting[held], size[held] = [], 0
        chunk = Chunk(rows.column("id").combine_chunks(), rows.column("text").combine_chunks(), held)
        seal = U(len(chunk.one)) + (chunk.three.sum(dtype=np.uint64) if len(chunk.three) else U(0))
        ordinal += 1
        return int(mix(np.array([U(part) * U(0x9E3779B97F4A7C15) + U(ordinal)]) + seal).view(np.int64)[0]), chunk

    for batch in slices(batches, "text"):
        mask = batch.column("held")
        for held in (True, False):
            rows = batch.filter(mask if held else pa.compute.invert(mask))
            if rows.num_rows:
                waiting[held].append(rows)
                size[held] += rows.column("text").nbytes
                if size[held] >= CHUNK:
                    yield close(held)
    for held in (True, False):
        if waiting[held]:
            yield close(held)


def _bucket_edges(buckets: int) -> np.ndarray:
    return np.array([-(-(k << 64) // buckets) for k in range(1, buckets)], np.uint64)


def requests(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk in chunks(batches):
            keys, counts = chunk.keys()
            if chunk.held:
                counts = np.zeros_like(counts)
            edges = np.concatenate([[0], np.searchsorted(keys, _bucket_edges(buckets)), [len(keys)]])
            full = np.flatnonzero(np.diff(edges))
            yield pa.RecordBatch.from_arrays(
                [pa.array(full, pa.int32()), pa.array(np.full(len(full), name), pa.int64()), pa.array(np.diff(edges)[full], pa.int32()), pa.array([_keys_out(keys[edges[k] : edges[k + 1]]) for k in full], pa.binary()), pa.array([squeeze(counts[edges[k] : edges[k + 1]], 8) for k in full], pa.binary())],
                names=["bucket", "chunk", "n", "keys", "counts"],
            )

    return run


def answer(group: pa.Table) -> pa.Table:
    """The corpus counts for each chunk's keys of one bucket, and a row of sums: words counted, different words, documents."""
    sizes = group.column("n").to_pylist()
    keys = np.concatenate([_keys_in(b, n) for b, n in zip(group.column("keys").to_pylist(), sizes)])
    counts = np.concatenate([unsqueeze(b, n, 8) for b, n in zip(group.column("counts").to_pylist(), sizes)])
    order = np.argsort(keys, kind="stable")
    first = np.ones(len(keys), bool)
    first[1:] = keys[order[1:]] != keys[order[:-1]]
    at = np.flatnonzero(first)
    sums = np.add.reduceat(counts[order], at)
    total = np.empty(len(keys), np.uint64)
    total[order] = sums[np.cumsum(first) - 1]
    different = keys[order[at]]
    words = (different & U(3)) == U(1)
    ends = np.cumsum(sizes)
    blobs = [squeeze(total[e - n : e], 8) for e, n in zip(ends.tolist(), sizes)]
    k = len(sizes)
    return pa.table(
        {
            "chunk": pa.array(group.column("chunk").to_pylist() + [None], pa.int64()), "bucket": pa.array(group.column("bucket").to_pylist() + [-1], pa.int32()), "n": pa.array(sizes + [0], pa.int32()), "counts": pa.array(blobs + [None], pa.binary()),
            "words": pa.array([None] * k + [int(sums[words].sum())], pa.int64()), "different": pa.array([None] * k + [int((sums[words] > 0).sum())], pa.int64()), "documents": pa.array([None] * k + [int(sums[different == U(END_KEY)].sum())], pa.int64()),
        }
    )


def documents_of(held_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, chunk in chunks(batches):
            if chunk.held or not held_only:
                sink = pa.BufferOutputStream()
                rows = pa.RecordBatch.from_arrays([chunk.ids, chunk.text], names=["id", "text"])
                with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(rows)
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([-2 if chunk.held else -3], pa.int32()), pa.array([0], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["chunk", "bucket", "n", "counts"])

    return run


def _open(group: pa.Table, documents: int) -> tuple[Chunk, tuple[np.ndarray, ...]] | None:
    group = group.sort_by("bucket")
    kinds = group.column("bucket").to_pylist()
    if kinds[0] >= 0:  # answers to a chunk that isn't asked for here
        return None
    if len(kinds) > 1 and kinds[1] < 0:
        raise RuntimeError("two chunks have one number")
    rows = pa.ipc.open_stream(group.column("counts")[0].as_py()).read_all().combine_chunks()
    chunk = Chunk(rows.column("id").combine_chunks(), rows.column("text").combine_chunks(), kinds[0] == -2)
    keys, where = chunk.keys(inverse=True)
    parts = [unsqueeze(b, n, 8) for b, n in zip(group.column("counts").to_pylist()[1:], group.column("n").to_pylist()[1:])]
    total = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if len(total) != len(keys):
        raise RuntimeError("a chunk was read differently when it was counted; the input isn't stable")
    return chunk, chunk.counts(total, where, documents)


def estimates(counts: tuple[np.ndarray, ...], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(context level, the 3-, 2- and 1-gram estimates) of each prediction."""
    uvw, uv, vw, v, w = counts
    p = np.zeros((3, len(w)))
    np.divide(uvw, uv, out=p[0], where=uv > 0)
    np.divide(vw, v, out=p[1], where=v > 0)
    p[2] = w / max(words, 1)
    depth = lambda c: np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), LEVELS - 1)
    return np.where(uv > 0, LEVELS + depth(uv), depth(v + 1)), np.minimum(p, 1.0)


def weights_by_em(level: np.ndarray, p: np.ndarray, count: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Mixture weights (level, order) that maximise the held-out likelihood; p holds the four estimates of each kind of prediction."""
    out = np.tile(START, (2 * LEVELS, 1))
    for _ in range(rounds):
        share = out[level] * p.T
        share *= (count / np.maximum(share.sum(axis=1), 1e-300))[:, None]
        for k in range(4):
            out[:, k] = np.bincount(level, share[:, k], 2 * LEVELS)
        mass = out.sum(axis=1, keepdims=True)
        pooled = out.sum(axis=0) / max(out.sum(), 1e-300) if out.sum() else START
        out = np.where(mass > 0, (out + 0.5 * pooled) / (mass + 0.5), pooled)
    return out


def score_documents(docs: DataFrame, held_share: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_prob, perplexity, held_out) of every row.

    One document in ``held_share``, by a hash of its id, is held out. ``n_tokens`` counts words and the end mark, so an empty text is 1
    token; a null text has null figures and isn't counted. Repeated rows and null ids are each counted and scored. Where nothing is held
    out the weights are equal. The input must read the same twice, as tables do; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), (F.pmod(F.xxhash64(id_col), F.lit(held_share)) == 0).alias("held"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = rows.mapInArrow(requests(buckets), "bucket int, chunk bigint, n int, keys binary, counts binary")
    answered = written(asked.groupBy("bucket").applyInArrow(answer, "chunk bigint, bucket int, n int, counts binary, words bigint, different bigint, documents bigint"), "counts")
    sums = answered.agg(F.sum("words"), F.sum("different"), F.sum("documents")).first()
    words, different, documents = (int(x or 0) for x in sums)
    flat = 1.0 / max(different + 1, 1)
    counts = answered.where("chunk is not null").select("chunk", "bucket", "n", "counts")

    def with_texts(held_only: bool) -> DataFrame:
        return rows.mapInArrow(documents_of(held_only), "chunk bigint, bucket int, n int, counts binary").unionByName(counts)

    def histogram(group: pa.Table) -> pa.Table:
        found = _open(group, documents)
        if found is None:
            return pa.table({"cell": pa.array([], pa.int64()), "n": pa.array([], pa.int64())})
        level, p = estimates(found[1], words)
        grid = np.full(p.shape, NEVER, np.int64)
        some = p > 0
        grid[some] = np.minimum(np.rint(-STEP * np.log2(p[some])), NEVER - 1).astype(np.int64)
        cell, n = np.unique(((level * 256 + grid[0]) * 256 + grid[1]) * 256 + grid[2], return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(n)})

    cells = with_texts(True).groupBy("chunk").applyInArrow(histogram, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().sort_by("cell")
    cell, n = np.asarray(cells.column("cell"), np.int64), np.asarray(cells.column("n"), np.float64)
    grid = np.stack([(cell >> s) & 255 for s in (16, 8, 0)])
    p = np.concatenate([np.where(grid == NEVER, 0.0, 2.0 ** (-grid / STEP)), np.full((1, len(cell)), flat)])
    weights = weights_by_em(cell >> 24, p, n)

    def score(group: pa.Table) -> pa.Table:
        found = _open(group, documents)
        if found is None:
            return pa.table({id_col: pa.array([], id_kind), "n_tokens": pa.array([], pa.int32()), "log_prob": pa.array([], pa.float64()), "perplexity": pa.array([], pa.float64()), "held_out": pa.array([], pa.bool_())})
        chunk, own = found
        level, p = estimates(own, words)
        mixed = weights[level, 3] * flat
        for k in range(3):
            mixed += weights[level, k] * p[k]
        size = np.diff(chunk.offsets)
        logs = np.add.reduceat(np.log(mixed), chunk.offsets[:-1]) if len(size) else np.zeros(0)
        total, tokens = np.zeros(len(chunk.live)), np.ones(len(chunk.live), np.int64)
        total[chunk.live], tokens[chunk.live] = logs, size
        gone = ~chunk.live
        return pa.table({id_col: chunk.ids, "n_tokens": pa.array(tokens, pa.int32(), mask=gone), "log_prob": pa.array(np.round(total, 6), mask=gone), "perplexity": pa.array(np.round(np.exp(-total / tokens), 6), mask=gone), "held_out": pa.array(np.full(len(gone), chunk.held))})

    from pyspark.sql.pandas.types import to_arrow_type

    id_kind = to_arrow_type(docs.schema[id_col].dataType)
    return with_texts(False).groupBy("chunk").applyInArrow(score, f"{id_col} {kind}, n_tokens int, log_prob double, perplexity double, held_out boolean")
