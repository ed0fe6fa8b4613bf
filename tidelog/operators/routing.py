"""Placement: canonical hashes of group values, and a consistent assignment of them to partitions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.schema import RoutingError

_NO_FORM = (T.MapType, T.UserDefinedType)


def canonical(value: Column) -> Column:
    """A value's canonical JSON: field names and list brackets are part of it, so different values differ."""
    return F.to_json(F.struct(value.alias("v")))


def content_hash(value: Column) -> Column:
    return F.sha2(canonical(value), 256)


def check_routable(kind: T.DataType) -> None:
    """Maps and user-defined types have no canonical order; groups of them are refused."""
    if isinstance(kind, _NO_FORM):
        raise RoutingError(f"{kind.simpleString()} has no canonical form")
    for part in [f.dataType for f in kind] if isinstance(kind, T.StructType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []:
        check_routable(part)


def route_id(group: Column) -> Column:
    """32 bits of the canonical hash; breaks timestamp ties between groups and places them."""
    return F.conv(F.substring(content_hash(group), 1, 8), 16, 10).cast("bigint")


def jump_hash(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key by jump consistent hashing (Lamping and Veach): one more bucket moves 1/(n+1) of the keys."""
    key = keys.astype(np.uint64)
    out, at = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    while len(live):
        out[live] = at[live]
        key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        at[live] = ((out[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[at[live] < buckets]
    return out


def bucket(route: Column, buckets: int) -> Column:
    """The partition that a route belongs to."""

    @F.pandas_udf("int")
    def of(keys: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(keys.to_numpy(), buckets).astype(np.int32))

    return of(route)


def place(df: DataFrame, group: str, partitions: int) -> DataFrame:
    """``df`` with each group in the partition that its route's jump hash says, so folds on it need no further shuffle and a further partition moves
    few groups."""
    check_routable(df.schema[group].dataType)
    return df.repartitionById(partitions, bucket(route_id(F.col(group)), partitions))
