"""Document fingerprints by locally consistent parsing.

Each level first names runs of one symbol, so neighbours differ; then deterministic coin tossing (the lowest bit in which a symbol
differs from its left neighbour, and that bit) reduces labels to at most six values in four rounds, a phrase begins at every local
maximum of the labels, and a phrase is named by its symbols. Where a phrase begins depends on the few symbols around it
alone, so equal substrings get equal names inside, wherever they stand.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._text import U, buffers, lists, mix, slices, word_hashes

_RUN, _PHRASE = U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB)
ROUNDS = 4


def name_runs(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(symbols with each run named by its symbol and length, index of each run's first symbol); ``first`` marks where texts begin."""
    new = np.ones(len(symbols), bool)
    new[1:] = (symbols[1:] != symbols[:-1]) | first[1:]
    at = np.flatnonzero(new)
    size = np.diff(np.append(at, len(symbols)))
    out = symbols[at].copy()
    long = size > 1
    out[long] = mix(out[long] * _RUN + size[long].astype(np.uint64))
    return out, at


def coin_labels(symbols: np.ndarray, first: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Labels in 0..5 after four rounds; neighbours in a text that differed still do."""
    x = symbols
    for _ in range(rounds):
        left = np.empty_like(x)
        left[1:] = x[:-1]
        left[first] = ~x[first]
        diff = x ^ left
        low = diff & (~diff + U(1))
        place = np.bitwise_count(low - U(1)).astype(np.uint64)
        x = U(2) * place + ((x >> place) & U(1))
    return x


def parse_level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(phrase names, index of each phrase's first symbol) of one level."""
    runs, at = name_runs(symbols, first)
    head = first[at]
    label = coin_labels(runs, head)
    rise = np.zeros(len(runs), bool)
    rise[1:] = label[1:] > label[:-1]
    rise[head] = True
    fall = np.ones(len(runs), bool)
    fall[:-1] = (label[:-1] > label[1:]) | head[1:]
    peak = rise & fall
    # a text's second symbol can't begin a phrase of its own when the first is alone before it: local maxima are never neighbours
    peak[1:] &= ~head[:-1]
    starts = np.flatnonzero(peak | head)
    size = np.diff(np.append(starts, len(runs)))
    where = (np.arange(len(runs)) - np.repeat(starts, size)).astype(np.uint64)
    names = np.add.reduceat(mix(runs + (where + U(1)) * _PHRASE), starts) if len(starts) else runs
    return mix(names + size.astype(np.uint64) * _PHRASE), at[starts]


def parse(words: np.ndarray, per_text: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(names at ``level``, their first words, offsets, the name of each whole text, levels that took)."""
    texts = len(per_text) - 1
    root, height = np.zeros(texts, np.uint64), np.zeros(texts, np.int32)
    live = np.flatnonzero(np.diff(per_text) > 0)
    first = np.zeros(len(words), bool)
    first[per_text[live]] = True
    symbols, place, text = words, np.arange(len(words)), np.repeat(np.arange(texts), np.diff(per_text))
    kept = None
    for depth in range(1, 80):
        if not len(symbols):
            break
        names, at = parse_level(symbols, first)
        symbols, place, first, text = names, place[at], first[at], text[at]
        if depth == level:
            kept = symbols, place, np.searchsorted(text, np.arange(texts + 1))
        heads = np.flatnonzero(first)
        single = heads[np.diff(np.append(heads, len(symbols))) == 1]
        fresh = single[height[text[single]] == 0]
        root[text[fresh]], height[text[fresh]] = symbols[fresh], depth
        if depth >= level and len(single):
            stay = np.ones(len(symbols), bool)
            stay[single] = False
            symbols, place, first, text = symbols[stay], place[stay], first[stay], text[stay]
    if kept is None:
        kept = symbols, place, np.zeros(texts + 1, np.int64)
    return *kept, root, height


def fingerprints(docs: DataFrame, level: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, fingerprint, levels, phrases, phrase_starts) of every row, in one narrow pass without a shuffle.

    ``fingerprint`` names the whole word sequence: equal for equal ones. ``phrases`` are the names at ``level`` in order, with the word
    that each begins at; texts that share a long enough passage share the names inside it. A null text gives nulls,
    one without words 0 words, a null fingerprint and empty lists; repeated rows each give a row; other columns are ignored.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_words int, fingerprint bigint, levels int, phrases array<bigint>, phrase_starts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        for part in slices(batches, text_col):
            text = part.column(text_col)
            words, per = word_hashes(*buffers(text))
            names, place, offsets, root, height = parse(words, per, level)
            count = np.diff(per)
            starts = place - np.repeat(per[:-1], np.diff(offsets))
            out = [pa.array(count, pa.int32()), pa.array(root.view(np.int64), mask=count == 0), pa.array(height, pa.int32()), lists(names.view(np.int64), offsets, pa.int64()), lists(starts, offsets, pa.int32())]
            if text.null_count:
                out = [pc.if_else(text.is_valid(), c, pa.scalar(None, c.type)) for c in out]
            yield pa.RecordBatch.from_arrays([part.column(id_col), *out], names=[id_col, "n_words", "fingerprint", "levels", "phrases", "phrase_starts"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
