"""The folder that all executors share, for tables that cut lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tidelog.shared import dropped, shared_folder, written

__all__ = ["checkpointed", "dropped", "unused", "written"]


def checkpointed(df: DataFrame) -> DataFrame:
    """An eager, reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def unused(name: str, df: DataFrame) -> str:
    """A column name that ``df`` hasn't got."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
