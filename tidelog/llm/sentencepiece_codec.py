"""Offset-preserving SentencePiece encoding, and decoding.

Normalisation is the model's own: at every place the longest prefix found in the compiled character map (a
double-array trie) is replaced, and each normalised byte keeps the original byte that it came from. Pieces are then
cut by the library on normalised text, and every piece is projected through that alignment to a byte span of the original.
No piece of a model that splits by white space holds a word mark inside it, so a text falls into stretches (a run of marks and
what follows it) that are encoded independently; each different stretch is encoded once per worker.
"""

from __future__ import annotations

import functools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._text import Memo, buffers, flat_ranges, lists, slices

MODEL = os.environ.get("TIDELOG_SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁".encode()


class CharacterMap:
    """Longest-prefix replacement through a compiled character map (trie size, double-array units, replacements)."""

    def __init__(self, blob: bytes, literal: list[bytes] = ()):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], np.uint32).astype(np.int64)
        self.strings = blob[4 + size :] if blob else b""
        self.literal = sorted(literal, key=len, reverse=True)

    @property
    def empty(self) -> bool:
        return not len(self.units) and not self.literal

    def matches(self, data: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(length, value) of the longest rule that begins at each byte and ends by ``last``; length 0 where none does."""
        n = len(data)
        length, value = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        if len(self.units):
            off = lambda u: (u >> 10) << ((u & 512) >> 6)
            live = np.arange(n)
            node = np.full(n, off(self.units[0]), np.int64)
            depth = 0
            while len(live):
                ok = live + depth < last[live]
                live, node = live[ok], node[ok]
                byte = data[live + depth].astype(np.int64)
                node = node ^ byte
                ok = node < len(self.units)
                live, node, byte = live[ok], node[ok], byte[ok]
                unit = self.units[node]
                ok = (unit & (0x80000000 | 0xFF)) == byte
                live, node, unit = live[ok], node[ok], unit[ok]
                node = node ^ off(unit)
                depth += 1
                leaf = (unit >> 8) & 1 == 1
                length[live[leaf]] = depth
                value[live[leaf]] = self.units[node[leaf]] & 0x7FFFFFFF
        if self.literal:
            raw = data.tobytes()
            for symbol in reversed(self.literal):
                at = raw.find(symbol)
                while at >= 0:
                    if at + len(symbol) <= last[at]:
                        length[at], value[at] = len(symbol), -2
                    at = raw.find(symbol, at + 1)
        return length, value

    def replace(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes, the original byte that each came from, offsets)."""
        last = np.repeat(offsets[1:], np.diff(offsets))
        length, value = self.matches(data, last)
        reached = (data & 0xC0) != 0x80
        own = np.diff(np.append(np.flatnonzero(reached), len(data)))
        step = np.zeros(len(data), np.int64)
        step[reached] = own
        for at in np.flatnonzero((length > step) & reached):
            if reached[at]:
                reached[at + 1 : at + length[at]] = False
        at = np.flatnonzero(reached)
        parts, sizes = [], np.empty(len(at), np.int64)
        kept = np.flatnonzero(value[at] < 0)
        take = np.where(length[at] > 0, length[at], step[at])
        swapped = np.flatnonzero(value[at] >= 0)
        sizes[kept] = take[kept]
        which, back = np.unique(value[at[swapped]], return_inverse=True)
        strings = [self.strings[v : self.strings.index(b"\0", v)] for v in which.tolist()]
        sizes[swapped] = np.array([len(s) for s in strings], np.int64)[back] if len(which) else 0
        begin = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.uint8)
        out[flat_ranges(begin[kept], sizes[kept])] = data[flat_ranges(at[kept], sizes[kept])]
        for j, s in enumerate(strings):
            if s:
                places = begin[swapped[back == j]]
                out[(places[:, None] + np.arange(len(s))).ravel()] = np.tile(np.frombuffer(s, np.uint8), len(places))
        align = np.repeat(at, sizes)
        bounds = np.append(begin, len(out))[np.searchsorted(at, offsets)]
        return out, align, bounds


class Codec:
    """Encoder and decoder of one SentencePiece model file."""

    def __init__(self, model: str = MODEL):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        with open(model, "rb") as f:
            proto = sentencepiece_model_pb2.ModelProto.FromString(f.read())
        spec = proto.normalizer_spec
        if proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("models whose word mark is a suffix are not supported")
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.map = CharacterMap(spec.precompiled_charsmap, [p.piece.encode() for p in proto.pieces if p.type == 4])
        self.cuts = self.escape and not any("▁" in p.piece.lstrip("▁") for p in proto.pieces)
        self.unk = next((i for i, p in enumerate(proto.pieces) if p.type == 2), -1)
        self.pieces = [p.piece.encode() for p in proto.pieces]
        self.byte = np.array([int(p.piece[3:5], 16) if p.type == 6 else -1 for p in proto.pieces])
        self.silent = np.array([p.type == 3 for p in proto.pieces])
        self.size = np.where(self.byte >= 0, 1, [len(p) for p in self.pieces]).astype(np.int64)
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces = b"", False, False
        spec.name = "identity"
        self.cutter = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        self.memo = Memo(lambda new: self.cutter.encode(new, num_threads=1), finish=self._measured)
        surfaces = [b" " * 5 if i == self.unk else b"" if self.silent[i] else bytes([self.byte[i]]) if self.byte[i] >= 0 else p.replace(MARK, b" ") for i, p in enumerate(self.pieces)]
        if self.unk >= 0:
            surfaces[self.unk] = b" \xe2\x81\x87 "
        self.surface_size = np.array([len(s) for s in surfaces], np.int64)
        self.surface_at = np.cumsum(self.surface_size) - self.surface_size
        self.surface = np.frombuffer(b"".join(surfaces), np.uint8)

    def normalise(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(normalised bytes with word marks, original byte of each and of the end, offsets); positions count from data[0]."""
        if self.map.empty:
            out, align = data, np.maximum.accumulate(np.where((data & 0xC0) != 0x80, np.arange(len(data)), 0))
        else:
            out, align, offsets = self.map.replace(data, offsets)
        space = out == 32
        # the alignment of a text's end: where its last kept byte's source stops
        ends = None
        if self.squeeze:
            text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            solid = np.flatnonzero(~space)
            has = np.zeros(len(offsets) - 1, bool)
            first, last = np.full(len(has), len(out)), np.full(len(has), -1)
            has[text[solid]] = True
            last[text[solid]] = solid
            first[text[solid[::-1]]] = solid[::-1]
            place = np.arange(len(out))
            before = np.zeros(len(out), bool)
            before[1:] = space[:-1]
            keep = (place >= first[text]) & (place <= last[text]) & ~(space & before)
            follows = np.minimum(last + 1, max(len(out) - 1, 0))
            inner = has & (last + 1 < offsets[1:])
            ends = np.where(inner, align[follows] if len(align) else 0, -1)
            offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
            out, align, space = out[keep], align[keep], space[keep]
        width = np.where(space, 3, 1) if self.escape else np.ones(len(out), np.int64)
        lead = (np.diff(offsets) > 0) & self.dummy
        mark = MARK if self.escape else b" "
        begin = np.cumsum(width) - width + np.repeat(np.cumsum(lead) * len(mark), np.diff(offsets))
        bounds = np.append(begin + width, 0)[offsets - 1] if len(out) else np.zeros(len(offsets), np.int64)
        bounds[0] = 0
        nothing = np.flatnonzero(np.diff(offsets) == 0)
        bounds = np.maximum.accumulate(np.where(offsets == 0, 0, bounds)) if len(nothing) else bounds
        total = int(width.sum() + lead.sum() * len(mark))
        norm = np.empty(total, np.uint8)
        source = np.empty(total, np.int64)
        marks = begin[space] if self.escape else begin[:0]
        norm[begin] = out
        source[begin] = align
        for k in range(3 if self.escape else 0):
            norm[marks + k] = MARK[k]
            source[marks + k] = align[space]
        heads = bounds[:-1][lead]
        for k in range(len(mark)):
            norm[heads + k] = mark[k]
            source[heads + k] = align[offsets[:-1][lead]]
        return norm, source, bounds, ends

    def encode_flat(self, data: np.ndarray, offsets: np.ndarray):
        """(ids, span starts, span ends, offsets): spans are byte positions within each text."""
        norm, source, bounds, ends = self.normalise(data, offsets)
        if len(norm) == 0:
            none = np.zeros(0, np.int64)
            return none, none, none, np.zeros(len(offsets), np.int64)
        cut = np.zeros(len(norm) + 1, bool)
        cut[bounds] = True
        if self.cuts:
            at = np.flatnonzero(norm[:-2] == MARK[0]) if len(norm) > 2 else np.zeros(0, np.int64)
            at = at[(norm[at + 1] == MARK[1]) & (norm[at + 2] == MARK[2])]
            is_mark = np.zeros(len(norm) + 3, bool)
            is_mark[at + 3] = True
            cut[at[~is_mark[at]]] = True
        edges = np.flatnonzero(cut)
        stretch = pa.LargeStringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(norm))
        coded = stretch.dictionary_encode()
        code = self.memo(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        ids = self.memo.ids[flat_ranges(self.memo.ends[code], self.memo.ends[code + 1] - self.memo.ends[code])]
        size = ids >> 32
        ids &= 0xFFFFFFFF
        stop = np.cumsum(size)
        origin = np.append(source, len(data))
        tokens = np.searchsorted(stop, bounds, side="left") + 1
        tokens[bounds == 0] = 0
        # what a text's last normalised byte is followed by is the end of its own original
        finish = offsets[1:] if ends is None else np.where(ends >= 0, ends, offsets[1:])
        start = origin[stop - size]
        end = origin[stop]
        some = np.flatnonzero(np.diff(tokens) > 0)
        end[tokens[1:][some] - 1] = finish[some]
        base = np.repeat(offsets[:-1], np.diff(tokens))
        return ids, start - base, end - base, tokens

    def _measured(self, ids: np.ndarray, stretches: list[str], ends: np.ndarray) -> np.ndarray:
        """Ids with their normalised lengths in the upper half; an unknown piece is as long as what it stands for."""
        lens = self.size[ids]
        if self.unk >= 0:
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids == self.unk), side="right")).tolist():
                pieces = self.cutter.encode(stretches[k], return_type="proto").pieces
                lens[ends[k] - len(pieces) : ends[k]] = [len(p.surface.encode()) if p.id == self.unk else self.size[p.id] for p in pieces]
        return ids | lens << 32

    def decode_flat(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, offsets) of the decoded texts: word marks become spaces, the leading one that encoding adds goes."""
        size = self.surface_size[ids]
        out = self.surface[flat_ranges(self.surface_at[ids], size)] if len(ids) else np.zeros(0, np.uint8)
        bounds = np.concatenate([[0], np.cumsum(size)])[offsets]
        if self.dummy:
            heads = bounds[:-1][(np.diff(bounds) > 0)]
            heads = heads[out[heads] == 32]
            keep = np.ones(len(out), bool)
            keep[heads] = False
            out, bounds = out[keep], np.concatenate([[0], np.cumsum(keep)])[bounds]
        return out, bounds


@functools.lru_cache(maxsize=4)
def codec(model: str) -> Codec:
    return Codec(model)


def _as_strings(data: np.ndarray, offsets: np.ndarray, valid: pa.Array | None = None) -> pa.Array:
    binary = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    try:
        return binary.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids that do not spell UTF-8
        return pa.array([b.decode("utf-8", "replace") for b in binary.to_pylist()], pa.string())


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece_ids, span_starts, span_ends, n_pieces, lossless) of every row, in one narrow pass without a shuffle.

    Spans are byte positions in the UTF-8 text, [start, end), in reading order; a character spelled by several byte pieces belongs to
    the last of them. ``lossless``: decoding gives the normalised text back; it doesn't where the text itself holds the word mark, which decodes to a space. A null text gives null lists and a null ``n_pieces``; an
    empty one gives empty lists. Repeated rows and null ids each give their own row; other columns are ignored.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, piece_ids array<int>, span_starts array<int>, span_ends array<int>, n_pieces int, lossless boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for part in slices(batches, text_col, 1 << 19):
            text = part.column(text_col)
            data, offsets = buffers(text)
            ids, start, end, per = own.encode_flat(data, offsets)
            back, bounds = own.decode_flat(ids, per)
            if own.map.empty and not own.squeeze:
                want, limits = data, offsets
            else:
                want, _, limits, _ = own.normalise(data, offsets)
                text_want = _as_strings(want, limits).to_pylist()
                joined = [t.replace("▁", " ")[1 if own.dummy else 0 :].encode() for t in text_want]
                want, limits = np.frombuffer(b"".join(joined), np.uint8), np.concatenate([[0], np.cumsum([len(j) for j in joined])]).astype(np.int64)
            same = np.diff(bounds) == np.diff(limits)
            if len(back) == len(want) and same.all():
                wrong = np.flatnonzero(back != want)
                same[np.searchsorted(limits, wrong, side="right") - 1] = False
            else:
                a, b = back.tobytes(), want.tobytes()
                same = np.array([a[bounds[k] : bounds[k + 1]] == b[limits[k] : limits[k + 1]] for k in range(len(same))], bool)
            gone = text.is_null()
            hide = lambda x: pa.array(x.to_numpy(zero_copy_only=False), x.type, mask=gone.to_numpy(zero_copy_only=False)) if text.null_count else x
            columns = [lists(v.astype(np.int32), per, pa.int32()) for v in (ids, start, end)]
            if text.null_count:
                import pyarrow.compute as pc

                columns = [pc.if_else(gone, pa.scalar(None, c.type), c) for c in columns]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *columns, hide(pa.array(np.diff(per), pa.int32())), hide(pa.array(same))], names=[id_col, "piece_ids", "span_starts", "span_ends", "n_pieces", "lossless"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def decode(pieces: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "piece_ids") -> DataFrame:
    """(doc_id, text) of every row of piece ids; a null list gives a null text, an empty list an empty one.

    Ids outside the vocabulary, and null ids within a list, raise an error. Bytes that are not UTF-8 become U+FFFD.
    """
    schema = f"{id_col} {pieces.schema[id_col].dataType.simpleString()}, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            column = batch.column(ids_col)
            filled = column.fill_null([]) if column.null_count else column
            offsets = np.asarray(filled.offsets, np.int64)
            values = filled.values
            if values.null_count:
                raise ValueError("a list of piece ids holds a null")
            ids = np.asarray(values, np.int64)[offsets[0] : offsets[-1]]
            if len(ids) and (ids.min() < 0 or ids.max() >= len(own.pieces)):
                raise ValueError("a piece id is outside the vocabulary")
            text = _as_strings(*own.decode_flat(ids, offsets - offsets[0]))
            if column.null_count:
                import pyarrow.compute as pc

                text = pc.if_else(column.is_null(), pa.scalar(None, pa.string()), text)
            yield pa.RecordBatch.from_arrays([batch.column(id_col), text], names=[id_col, "text"])

    return pieces.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)
