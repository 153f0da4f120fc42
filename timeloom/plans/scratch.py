"""Tables that cut lineage: written once to the shared checkpoint folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_inside: ContextVar[str | None] = ContextVar("inside", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Where that is unset, a temporary one of this machine, if the executors are threads of it; else an error, as each executor would write to its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not (sc.master == "local" or sc.master.startswith("local[")):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="timeloom-")
        sc.setCheckpointDir(folder)
    return _inside.get() or sc.getCheckpointDir()


@contextmanager
def scope(spark: SparkSession) -> Iterator[str]:
    """Tables written inside go to a folder of their own, which is deleted at the end: use results before, or write them elsewhere."""
    folder = f"{scratch_dir(spark)}/scope-{uuid.uuid4().hex}"
    token = _inside.set(folder)
    try:
        yield folder
    finally:
        _inside.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame, **options: int) -> DataFrame:
    """df from a written table: later jobs start there, whichever executors are lost. options: of Parquet's writer."""
    path = f"{scratch_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
