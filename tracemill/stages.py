"""Stage boundaries: results written to the folder that the cluster shares, so later stages don't depend on executors."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scratch: ContextVar[str | None] = ContextVar("stages_scratch", default=None)


def new_path(spark: SparkSession) -> str:
    """A new path below spark.checkpoint.dir, or below the scratch folder that is open. Where it is unset, a temporary folder is set, but only for a local master, as in tests."""
    if _scratch.get():
        return f"{_scratch.get()}/stage-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        at = sc.getCheckpointDir()
    return f"{at.rstrip('/')}/stage-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write df below spark.checkpoint.dir and read it again."""
    path = new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is kept within, deleted at the end, also after a failure. Results are to be written elsewhere before that."""
    path = new_path(spark)
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
