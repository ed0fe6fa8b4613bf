"""Timelines: for each key, values by their position in event order.

A timeline is a DataFrame (key columns, ord, value); ``ord`` is any orderable column, as a rule a struct, which compares
lexicographically. Points in time are looked up by one union and one window over the key, so an as-of join costs a sort and not
a product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(timeline: DataFrame, rows: DataFrame, key: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """``timeline`` with ``rows``; a row at the same key and position replaces the one there."""
    return remove(timeline, rows, key, ord_col).unionByName(rows.select(*timeline.columns))


def remove(timeline: DataFrame, positions: DataFrame, key: Sequence[str], ord_col: str = "ord") -> DataFrame:
    return timeline.join(positions.select(*key, ord_col).distinct(), [*key, ord_col], "left_anti").select(*timeline.columns)


def get(timeline: DataFrame, positions: DataFrame, key: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """The values at exactly these positions."""
    return timeline.join(positions.select(*key, ord_col).distinct(), [*key, ord_col])


def contains(timeline: DataFrame, positions: DataFrame, key: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """The positions that are in the timeline."""
    return positions.join(timeline.select(*key, ord_col), [*key, ord_col], "left_semi")


def _as_of(left: DataFrame, timeline: DataFrame, key: Sequence[str], ord_col: str, value: str, inclusive: bool, into: str) -> DataFrame:
    found = F.struct(F.col(ord_col).alias("ord"), F.col(value).alias("value"))
    own = F.struct(*left.columns)
    kind = f"struct<ord:{timeline.schema[ord_col].dataType.simpleString()},value:{timeline.schema[value].dataType.simpleString()}>"
    writes = timeline.select(*key, F.col(ord_col).alias("__ord"), F.lit(0 if inclusive else 1).alias("__side"), found.alias("__found"), F.lit(None).cast(left.select(own.alias("r")).schema["r"].dataType).alias("__row"))
    reads = left.select(*key, F.col(ord_col).alias("__ord"), F.lit(1 if inclusive else 0).alias("__side"), F.lit(None).cast(kind).alias("__found"), own.alias("__row"))
    upto = Window.partitionBy(*key).orderBy("__ord", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = writes.unionByName(reads).withColumn("__last", F.last("__found", ignorenulls=True).over(upto)).where("__row is not null")
    return seen.select("__row.*", F.col("__last.ord").alias(f"{into}_ord"), F.col("__last.value").alias(into))


def latest_at(left: DataFrame, timeline: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value", into: str = "latest") -> DataFrame:
    """Each row of ``left`` with the latest value at or before its position, and that value's position; null where there is none."""
    return _as_of(left, timeline, key, ord_col, value, True, into)


def latest_before(left: DataFrame, timeline: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value", into: str = "latest") -> DataFrame:
    """As ``latest_at``, but strictly before the position."""
    return _as_of(left, timeline, key, ord_col, value, False, into)


def own_before(timeline: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value", into: str = "previous") -> DataFrame:
    """Each row with its key's latest earlier non-null value: a fold's read of its own state."""
    w = Window.partitionBy(*key).orderBy(ord_col).rowsBetween(Window.unboundedPreceding, -1)
    return timeline.withColumn(into, F.last(value, ignorenulls=True).over(w))


def next_after(timeline: DataFrame, key: Sequence[str], ord_col: str = "ord", into: str = "next_ord") -> DataFrame:
    """Each row with the position of the key's next write."""
    return timeline.withColumn(into, F.lead(ord_col).over(Window.partitionBy(*key).orderBy(ord_col)))


def first(timeline: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    return timeline.groupBy(*key).agg(F.min(ord_col).alias(ord_col), F.min_by(value, ord_col).alias(value))


def last(timeline: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """The current value of every key."""
    return timeline.groupBy(*key).agg(F.max(ord_col).alias(ord_col), F.max_by(value, ord_col).alias(value))


def keys(timeline: DataFrame, key: Sequence[str]) -> DataFrame:
    return timeline.select(*key).distinct()


def history(timeline: DataFrame, key_is: Column, ord_col: str = "ord") -> DataFrame:
    """One key's writes in order."""
    return timeline.where(key_is).orderBy(ord_col)


def sizes(timeline: DataFrame, key: Sequence[str]) -> DataFrame:
    return timeline.groupBy(*key).agg(F.count("*").alias("size"))


def range_between(bounds: DataFrame, timeline: DataFrame, key: Sequence[str], low: str, high: str | None, ord_col: str = "ord") -> DataFrame:
    """Each bound with the writes of its key in (low, high], or after ``low`` where ``high`` is None."""
    writes = timeline.withColumnRenamed(ord_col, "__ord")
    joined = bounds.join(writes, list(key))
    inside = F.col("__ord") > F.col(low)
    if high is not None:
        inside = inside & (F.col("__ord") <= F.col(high))
    return joined.where(inside).withColumnRenamed("__ord", f"write_{ord_col}")


def diff(old: DataFrame, new: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """(key, ord, change, old_value, new_value): positions added, removed, or whose value differs."""
    a = old.select(*key, ord_col, F.col(value).alias("old_value"), F.lit(True).alias("__a"))
    b = new.select(*key, ord_col, F.col(value).alias("new_value"), F.lit(True).alias("__b"))
    both = a.join(b, [*key, ord_col], "full_outer")
    change = F.when(F.col("__a").isNull(), "add").when(F.col("__b").isNull(), "remove").when(~F.col("old_value").eqNullSafe(F.col("new_value")), "update")
    return both.withColumn("change", change).where("change is not null").select(*key, ord_col, "change", "old_value", "new_value")


def key_diff(old: DataFrame, new: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """(key, change): keys added, removed, or with any difference in their timelines."""
    a, b = keys(old, key).withColumn("__a", F.lit(True)), keys(new, key).withColumn("__b", F.lit(True))
    touched = diff(old, new, key, ord_col, value).select(*key).distinct()
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").otherwise("changed")
    return touched.join(a, list(key), "left").join(b, list(key), "left").select(*key, kind.alias("change"))


def apply_diff(old: DataFrame, changes: DataFrame, key: Sequence[str], ord_col: str = "ord", value: str = "value") -> DataFrame:
    """``old`` after the changes of ``diff``."""
    kept = old.join(changes.select(*key, ord_col), [*key, ord_col], "left_anti").select(*key, ord_col, value)
    return kept.unionByName(changes.where("change <> 'remove'").select(*key, ord_col, F.col("new_value").alias(value)))


def remap(timeline: DataFrame, f, value: str = "value") -> DataFrame:
    """``timeline`` with ``f`` (column to column) applied to its values."""
    return timeline.withColumn(value, f(F.col(value)))


def same_events(timeline: DataFrame, key: Sequence[str], ord_col: str = "ord") -> DataFrame:
    """The set variant: positions without values."""
    return timeline.select(*key, ord_col).distinct()
