"""Intermediate results as written tables in the cluster's shared folder.

A written table cuts the lineage: what follows reads files, so a lost executor costs no
recomputation of what came before, and two readers see the same rows in the same parts.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    A session with local threads alone gets a temporary one where it is unset; on a cluster
    executors would write to their own disks there, so an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="callqc-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    folder = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    if (own := _made.get()) is not None:
        own.append(folder)
    return folder


@contextlib.contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[str]]:
    """Folders made inside are deleted at the end, but for those taken out of the list that it gives.

    For a step whose result has been written when it ends: until then its plan reads them.
    """
    own: list[str] = []
    token = _made.set(own)
    try:
        yield own
    finally:
        _made.reset(token)
        for folder in own:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table."""
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
