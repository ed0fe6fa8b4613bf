"""The folder that all executors share, and tables in it that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_paths: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; where it is unset and Spark is local (tests), a temporary folder that is then set for the context.
    On a cluster without that setting it is an error, as executors don't share a folder of the driver's machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context._jsc.sc().getCheckpointDir().isDefined():
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            context.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='tidelog-')}")
        folder = context._jsc.sc().getCheckpointDir().get()
    return folder.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder; it lives as long as that folder, as checkpoints do, or until ``dropped``. ``options`` are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidelog-{name}-{uuid.uuid4().hex}"
    df.write.options(compression="zstd", **options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[out] = path
    return out


def dropped(table: DataFrame) -> None:
    """Delete what ``written`` made; nothing that is still to be computed may read it."""
    context = table.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(_paths.pop(table))
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
