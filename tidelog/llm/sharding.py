"""Sharding by vector bin packing: bytes, tokens and rows are balanced jointly.

Documents are packed in units: a group, or a hash part of one that would fill more than ``unit_share`` of a shard. Units go in
descending order of their largest share to the shard whose residual capacity has the highest dot product with the unit's vector, among
those with room in all three. Units and shards are split by hash into cells of at most ``cell_shards`` shards, packed independently,
so packing is distributed too.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm._session import written

DIMENSIONS = ("bytes", "tokens", "rows")


def pack(vectors: np.ndarray, shards: int, slack: float) -> np.ndarray:
    """The shard of each vector, which are in the order to place; a shard's capacity is the mean load and ``slack`` of it."""
    load = vectors / np.maximum(vectors.sum(axis=0) / shards, 1e-300)
    room = np.full((shards, vectors.shape[1]), 1.0 + slack)
    out = np.zeros(len(vectors), np.int64)
    for k, v in enumerate(load):
        fits = (room >= v - 1e-12).all(axis=1)
        # where it fits nowhere it goes where the tightest dimension stays loosest
        score = np.where(fits, room @ v, -np.inf) if fits.any() else (room - v).min(axis=1)
        out[k] = int(np.argmax(score))
        room[out[k]] -= v
    return out


def shard_documents(docs: DataFrame, n_shards: int | None = None, shard_bytes: int = 64 << 20, by: tuple[str, ...] = ("source", "lang"), slack: float = 0.02, unit_share: float = 0.125, cell_shards: int = 256, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, shard, bytes, tokens) of every row. Without ``n_shards`` there are as many shards as ``shard_bytes`` of text fill.

    Texts are read once, to measure them; the measures are a written table of a few bytes a row. A null text is 0 bytes and 0
    tokens, and a token is a word here; null group values form a group of their own. Rows that share an id and group share the shard;
    ties in size go by unit name. A row that is more than a shard holds has room nowhere and goes where the tightest dimension stays loosest. An empty table gives no
    rows; other columns are ignored.
    """
    words = F.regexp_count(F.col(text_col), F.lit("[^ \\t\\n\\x0B\\f\\r]+"))
    unit_name = F.to_json(F.struct(*[F.col(c).cast("string").alias(f"g{k}") for k, c in enumerate(by)]))
    measured = written(docs.select(F.col(id_col).alias("id"), unit_name.alias("grp"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("bigint").alias("bytes"), F.coalesce(words, F.lit(0)).cast("bigint").alias("tokens")), "measures")
    sums = [F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    total = measured.agg(*sums).first()
    n_shards = n_shards or max(1, -(-(total["bytes"] or 0) // shard_bytes))
    share = F.greatest(*[F.col(d) * F.lit(n_shards / max(1, total[d] or 0)) for d in DIMENSIONS])
    parts = measured.groupBy("grp").agg(*sums).select("grp", F.greatest(F.lit(1), F.ceil(share / unit_share)).cast("bigint").alias("parts"))
    own = measured.join(parts, "grp").withColumn("unit", F.concat_ws("#", "grp", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.col("parts")).cast("string")))
    cells = math.ceil(n_shards / cell_shards)

    def place(cell: pa.Table) -> pa.Table:
        c = cell.column("cell")[0].as_py()
        low, high = n_shards * c // cells, n_shards * (c + 1) // cells
        vectors = np.stack([np.asarray(cell.column(d), dtype=np.float64) for d in DIMENSIONS], axis=1)
        names = np.array(cell.column("unit").to_pylist(), dtype=object)
        size = (vectors / np.maximum(vectors.sum(axis=0), 1e-300)).max(axis=1)
        order = sorted(range(len(names)), key=lambda k: (-size[k], names[k]))
        shard = np.zeros(len(names), np.int64)
        shard[order] = pack(vectors[order], high - low, slack) + low
        return pa.table({"unit": cell.column("unit"), "shard": pa.array(shard, pa.int32())})

    units = own.groupBy("unit").agg(*sums).withColumn("cell", F.pmod(F.xxhash64("unit"), F.lit(cells)).cast("int"))
    placed = units.groupBy("cell").applyInArrow(place, "unit string, shard int")
    return own.join(placed, "unit").select(F.col("id").alias(id_col), "shard", "bytes", "tokens")
