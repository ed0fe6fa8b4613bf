"""Token ids as fixed-stride binary shards in training order.

Documents, an end mark after each, are joined within a task and cut into sequences of ``length`` tokens, so only a task's last one is padded. A keyed Feistel permutation with cycle-walking maps the dense index of
each sequence to its slot in the training order, a bijection on 0..N-1; shard k holds the slots from k * per_shard on, each at the
same stride, so any slot is one seek away and reading resumes from a slot number alone.
"""

from __future__ import annotations

import base64
import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._session import written
from tidelog.llm._text import SPACE, Memo, U, buffers, flat_ranges, mix, slices
from tidelog.shared import shared_folder

RANKS = os.environ.get("TIDELOG_BPE_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Tokenizer:
    """Byte-level BPE of a rank file. Text is cut before a lone space and around a lone line break, where the pattern always
    begins a new match, so stretches are encoded independently and each different one once per worker."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.end = len(ranks)
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.memo = Memo(lambda new: list(map(own.encode_ordinary, new)))

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        cut = np.zeros(n + 1, bool)
        lone = np.zeros(n, bool)
        space = SPACE[data]
        lone[1:-1] = space[1:-1] & ~space[:-2] & ~space[2:]
        cut[:-1] = lone & ((data == 32) | (data == 10))
        cut[1:] |= lone & (data == 10)
        cut[offsets] = True
        edges = np.flatnonzero(cut)
        coded = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(data)).dictionary_encode()
        where = self.memo(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        sizes = self.memo.ends[where + 1] - self.memo.ends[where]
        ids = self.memo.ids[flat_ranges(self.memo.ends[where], sizes)]
        return ids, np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(edges, offsets)]


@functools.lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def width_of(ranks: str) -> int:
    """Bytes of a token id: 2 where the vocabulary and its end mark fit, else 4."""
    with open(ranks, "rb") as f:
        return 2 if sum(1 for _ in f) < 1 << 16 else 4


def feistel(index: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """The slot of each index in 0..n-1: a balanced Feistel network on the smallest even number of bits that holds n, walked until it falls below n."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = U((1 << half) - 1)
    keys = mix(np.arange(1, rounds + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15) + U(key & (2**64 - 1)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        x = out[todo]
        left, right = x >> U(half), x & mask
        for k in keys:
            left, right = right, left ^ (mix(right * U(0xD6E8FEB86659FD93) + k) & mask)
        out[todo] = (left << U(half)) | right
        todo = todo[out[todo] >= U(n)]
    return out.astype(np.int64)


def sequences(docs: DataFrame, length: int, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, ordinal, docs, n_tokens, tokens): tokens of the task's documents with their end marks, joined and cut to ``length``; the last sequence is
    filled up with end marks, which ``n_tokens`` doesn't count.

    ``docs`` lists the pieces of a sequence: the document, where in the sequence the piece starts, and which token of the document that is.
    ``tokens`` is little-endian binary. ``part`` and ``ordinal`` number the rows of the task that made them.
    """
    width = width_of(ranks)
    kind = np.dtype("<u2") if width == 2 else np.dtype("<u4")
    schema = f"part int, ordinal bigint, docs {PIECES.format(docs.schema[id_col].dataType.simpleString())}, n_tokens int, tokens binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, done, own = TaskContext.get().partitionId(), 0, tokenizer(ranks)
        # what isn't a whole sequence yet: its tokens, and the document, first place and token of each of its pieces
        rest, rest_ids, rest_at, rest_from = np.zeros(0, kind), None, np.zeros(0, np.int64), np.zeros(0, np.int64)

        def give(flat: np.ndarray, ids: pa.Array, at: np.ndarray, begins: np.ndarray, real: int) -> pa.RecordBatch:
            """The whole sequences of ``flat``, whose pieces begin at ``at``, of which the first ``real`` tokens count."""
            nonlocal done
            n = len(flat) // length
            ends = np.append(at[1:], real)
            first, last = at // length, np.maximum(ends - 1, at) // length
            owner = np.repeat(np.arange(len(at)), last - first + 1)
            seq = flat_ranges(first, last - first + 1)
            begin = np.maximum(at[owner], seq * length)
            pieces = pa.StructArray.from_arrays([ids.take(pa.array(owner)), pa.array(begin - seq * length, pa.int32()), pa.array(begins[owner] + begin - at[owner])], names=["doc", "start", "token"])
            lists_ = pa.ListArray.from_arrays(pa.array(np.searchsorted(seq, np.arange(n + 1)), pa.int32()), pieces)
            tokens = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * (length * width)), pa.py_buffer(np.ascontiguousarray(flat[: n * length]))])
            counts = np.minimum(real - np.arange(n) * length, length)
            out = pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(done, done + n)), lists_, pa.array(counts, pa.int32()), tokens], names=["part", "ordinal", "docs", "n_tokens", "tokens"])
            done += n
            return out

        for rows in slices(batches, text_col, 2 << 20):
            rows = rows.filter(rows.column(text_col).is_valid())
            if not rows.num_rows:
                continue
            coded, per = own.encode_flat(*buffers(rows.column(text_col)))
            sizes = np.diff(per) + 1
            begin = np.cumsum(sizes) - sizes
            fresh = np.full(int(sizes.sum()), own.end, kind)
            fresh[flat_ranges(begin, sizes - 1)] = coded
            flat = np.concatenate([rest, fresh])
            ids = rows.column(id_col)
            ids = ids if rest_ids is None else pa.concat_arrays([rest_ids, ids])
            at, froms = np.concatenate([rest_at, begin + len(rest)]), np.concatenate([rest_from, np.zeros(len(begin), np.int64)])
            whole = len(flat) // length * length
            k = int(np.searchsorted(at, whole, side="right"))
            if whole:
                yield give(flat[:whole], ids.slice(0, k) if at[k - 1] < whole else ids.slice(0, k - 1), *((at[:k], froms[:k]) if at[k - 1] < whole else (at[: k - 1], froms[: k - 1])), whole)
            if whole == len(flat):
                rest, rest_ids, rest_at, rest_from = np.zeros(0, kind), None, np.zeros(0, np.int64), np.zeros(0, np.int64)
            else:
                first = k - 1  # the piece that the rest begins in
                rest, rest_ids = flat[whole:], ids.slice(first)
                rest_at, rest_from = at[first:] - whole, froms[first:].copy()
                rest_from[0] -= min(rest_at[0], 0)
                rest_at = np.maximum(rest_at, 0)
        if len(rest):
            padded = np.full(length, own.end, kind)
            padded[: len(rest)] = rest
            yield give(padded, rest_ids, rest_at, rest_from, len(rest))

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


PIECES = "array<struct<doc:{},start:int,token:bigint>>"


def _placed(docs: DataFrame, length: int, per_shard: int, key: int, ranks: str, id_col: str, text_col: str, sample: int) -> tuple[DataFrame, bytes]:
    """(the training order with ``tokens`` compressed, the dictionary for that): one shuffle, of compressed sequences.

    The dictionary is made from the first ``sample`` sequences of the table; it bears on nothing but sizes.
    """
    table = written(sequences(docs, length, ranks, id_col, text_col), "sequences", **{"parquet.compression.codec.zstd.level": "9", "parquet.page.size": str(8 << 20)})
    counts = sorted((r.part, r.n) for r in table.groupBy("part").agg(F.count("*").alias("n")).collect())  # a row for each file split
    total = sum(n for _, n in counts)
    begin = np.zeros(max([p for p, _ in counts], default=-1) + 1, np.int64)
    at = 0
    for p, n in counts:
        begin[p] = at
        at += n
    some = [r.tokens for r in table.select("tokens").limit(sample).collect()]  # a bounded sample, without a shuffle
    dictionary = zstandard.train_dictionary(110 << 10, list(map(bytes, some))).as_bytes() if len(some) > 1000 else b""
    stride = length * width_of(ranks)
    kind = table.schema["docs"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_checksum=False, write_dict_id=False)
        for rows in batches:
            slot = feistel(begin[np.asarray(rows.column("part"))] + np.asarray(rows.column("ordinal")), total, key)
            tokens = pa.array([press.compress(t.as_buffer()) for t in rows.column("tokens")], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(slot // per_shard, pa.int32()), pa.array(slot % per_shard * stride), rows.column("docs"), rows.column("n_tokens"), tokens], names=["slot", "shard", "byte_offset", "docs", "n_tokens", "tokens"])

    out = table.mapInArrow(run, f"slot bigint, shard int, byte_offset bigint, docs {kind}, n_tokens int, tokens binary")
    return out.repartitionById(max(1, -(-total // per_shard)), F.col("shard")).sortWithinPartitions("slot"), dictionary


def _opened(rows: pa.RecordBatch, dictionary: bytes) -> pa.RecordBatch:
    """The rows with their tokens as they were."""
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    tokens = pa.array([reader.decompress(t.as_buffer()) for t in rows.column("tokens")], pa.binary())
    return rows.set_column(rows.schema.get_field_index("tokens"), "tokens", tokens)


def training_order(docs: DataFrame, length: int = 512, per_shard: int = 65536, key: int = 20260101, ranks: str = RANKS, id_col: str = "doc_id", text_col: str = "text", sample: int = 8000) -> DataFrame:
    """(slot, shard, byte_offset, docs, n_tokens, tokens) of every sequence, range-partitioned and sorted by slot; ``docs`` as in ``sequences``.

    Tokens are computed once and written to the shared folder, which fixes each sequence's index; only they are shuffled, once, and
    each shard is one partition. A null text has no tokens, an empty one a single end mark, a very long one many sequences; repeated rows and null ids
    each give their own tokens; other columns are ignored; an empty table gives no rows.
    """
    ordered, dictionary = _placed(docs, length, per_shard, key, ranks, id_col, text_col, sample)
    return ordered.mapInArrow(lambda batches: (_opened(rows, dictionary) for rows in batches), ordered.schema)


def shard_path(folder: str, shard: int) -> str:
    return f"{folder}/shard-{shard:08d}.bin"


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def write_shards(ordered: DataFrame, folder: str, dictionary: bytes | None = None) -> DataFrame:
    """(slot, shard, byte_offset, docs, n_tokens, path): the sequences, in the raw files that the tasks write to ``folder``, a path or URI that all
    executors see. A row appears when its file is there.

    A file is written under another name and renamed, so a task that is run again replaces it whole. With ``dictionary`` tokens come compressed.
    """
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ordered.drop("tokens").schema) + ", path string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root)
        current, out, name, waiting = None, None, "", []

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                store.move(name, shard_path(root, current))
                for rows in waiting:
                    yield rows.append_column("path", pa.array([shard_path(folder, current)] * rows.num_rows, pa.string()))

        for batch in batches:
            batch = batch if dictionary is None else _opened(batch, dictionary)
            shards = np.asarray(batch.column("shard"))
            cuts = np.flatnonzero(np.concatenate([[True], shards[1:] != shards[:-1]])) if len(shards) else []
            for a, b in zip(cuts, [*cuts[1:], len(shards)]):
                if shards[a] != current:
                    yield from close()
                    current, waiting = int(shards[a]), []
                    name = f"{root}/.{uuid.uuid4().hex}"
                    out = store.open_output_stream(name)
                rows = batch.slice(a, b - a)
                tokens = rows.column("tokens")
                _, ends, data = tokens.buffers()
                low, high = np.frombuffer(ends, np.int32)[[tokens.offset, tokens.offset + len(tokens)]]
                out.write(data.slice(int(low), int(high - low)))
                waiting.append(rows.drop_columns(["tokens"]))
        yield from close()

    return ordered.mapInArrow(run, schema)


def materialised(docs: DataFrame, length: int = 512, per_shard: int = 65536, key: int = 20260101, ranks: str = RANKS, folder: str | None = None) -> DataFrame:
    """The training order as shard files in ``folder``, by default a new one in the shared folder, and a row for every sequence, as ``write_shards`` gives them."""
    ordered, dictionary = _placed(docs, length, per_shard, key, ranks, "doc_id", "text", 8000)
    return write_shards(ordered, folder or f"{shared_folder(docs.sparkSession)}/tidelog-shards-{uuid.uuid4().hex}", dictionary)


def read_from(folder: str, slot: int, length: int = 512, per_shard: int = 65536, width: int = 2) -> Iterator[np.ndarray]:
    """The sequences from ``slot`` on, in training order: one seek, then sequential reads over the shards. ``folder`` is a path or URI, as it was written."""
    from pyarrow import fs

    store, root = _store(folder)
    stride, shard = length * width, slot // per_shard
    skip = (slot % per_shard) * stride
    while store.get_file_info(shard_path(root, shard)).type == fs.FileType.File:
        with store.open_input_file(shard_path(root, shard)) as f:
            f.seek(skip)
            while block := f.read(stride):
                yield np.frombuffer(block, "<u2" if width == 2 else "<u4")
        shard, skip = shard + 1, 0
