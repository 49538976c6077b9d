"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: Folders of this thread's open `scratch` blocks below the shared folder, innermost last.
_open: ContextVar[tuple[str, ...]] = ContextVar("scratch", default=())


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir); a folder of our own only in local mode, where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="tracelake-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(base)
        spark.conf.set("spark.checkpoint.dir", base)
    return "/".join([base.rstrip("/"), *_open.get()])


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def saved_alone(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table that build returns, saved; the tables that were saved on the way to it are deleted."""
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    with scratch(spark):
        df = build()
        schema = df.schema
        df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables saved inside are deleted at the end; what is needed later must be saved outside."""
    name = f"scratch-{uuid.uuid4().hex}"
    outer = _open.set((*_open.get(), name))
    folder = scratch_dir(spark)
    try:
        yield
    finally:
        _open.reset(outer)
        release(spark)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
