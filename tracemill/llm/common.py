"""What the operators of this subpackage share: reading tables, cutting lineage, batch sizes, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Rows and bytes that one Arrow batch may hold; texts can be long, so both are far below Spark's defaults. A longer text is a batch alone.
BATCH_ROWS, BATCH_BYTES = 512, 4 << 20
_scratch: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Lower the session's Arrow batch size to `rows` and BATCH_BYTES where it is larger.

    Spark reads these settings when a plan runs, which is after an operator has returned it, so they stay lowered.
    """
    for key, default, most in (("maxRecordsPerBatch", 10_000, rows), ("maxBytesPerBatch", -1, BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}", None)
        now = int(now) if now and now.lstrip("-").isdigit() else default
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def shared_dir(spark: SparkSession) -> str:
    """A new path below the session's checkpoint folder. Only a local master, as in tests, may do without the setting."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        at = sc.getCheckpointDir()
    return f"{at.rstrip('/')}/tracemill-{uuid.uuid4().hex}"


def keep(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and read it again: later stages do not depend on any executor's disk."""
    if path is None:
        path = f"{_scratch.get()}/{uuid.uuid4().hex}" if _scratch.get() else shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that keep() wrote."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder for all that is kept within, deleted at the end: what is to last is kept at a path of its own."""
    path = shared_dir(spark)
    token = _scratch.set(path)
    try:
        yield path
    finally:
        _scratch.reset(token)
        remove(spark, path)


def free_name(columns: list[str], name: str) -> str:
    """A column name that is not among the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def quoted(columns: list[str]) -> list[Column]:
    """The columns of these names, which may have dots and the like in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def map_rows(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType) -> DataFrame:
    """df.mapInArrow(run, schema) for columns of any names: in `run` they are c0, c1, ... by their places."""
    fields = [StructField(f"c{k}", f.dataType, f.nullable) for k, f in enumerate(schema.fields)]
    return df.toDF(*(f"c{k}" for k in range(len(df.columns)))).mapInArrow(run, StructType(fields)).toDF(*schema.names)


def lookup(df: DataFrame, small: DataFrame, on: list[str], spread: list[str], salts: int = 16) -> DataFrame:
    """df joined with small(on, ...), each key's rows being dealt to `salts` parts by the columns `spread`, so no key is one task.

    small's rows go to every part, so it should have far fewer rows than df. A part that is still large is split by Spark. The
    join is one of sorted sides: the repeated rows compress so well that Spark would take them for small enough to broadcast.
    """
    salt = free_name([*df.columns, *small.columns], "salt")
    parts = small.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn(salt, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")).join(parts.hint("merge"), [*on, salt]).drop(salt)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an edge list (src, dst) -> (node, root), root being the smallest node of each component.

    Nodes are of any type that has an order. Alternating large-star and small-star rounds, O(log n) of them for long chains.
    Each round looks up the smallest neighbour of every edge's end in a join on that end. A hub, a node with more than a
    hundredth of all edges (and 1000), would be one task there, so hubs, of which there are at most two hundred, are looked up
    in a broadcast table wherever their edges are. Only a count and a checksum reach the driver. Each round writes three tables
    in the shared folder, deleted when they are no longer needed. Null ends and loops are ignored.
    """
    spark, base = edges.sparkSession, _scratch.get() or shared_dir(edges.sparkSession)
    base, step = f"{base}/components-{uuid.uuid4().hex}", 0

    def kept(df: DataFrame, needed: int) -> DataFrame:
        """df as the next table; of those before it, the last `needed` - 1 stay."""
        nonlocal step
        out = keep(df, f"{base}/{step}")
        if step >= needed:
            remove(spark, f"{base}/{step - needed}")
        step += 1
        return out

    def with_least(df: DataFrame, low: DataFrame, hubs: DataFrame | None) -> DataFrame:
        if hubs is None:
            return df.join(low, "src")
        own = F.broadcast(low.join(F.broadcast(hubs), "src", "left_semi"))
        return df.join(own, "src").unionByName(df.join(F.broadcast(hubs), "src", "left_anti").join(low, "src"))

    e = edges.where("src is not null and dst is not null and src <> dst")
    e, before = kept(e.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct(), 3), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        low = both.groupBy("src").agg(F.min("dst").alias("m"), F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)")).alias("sum"))
        low = kept(low, 3)
        n, total, most = low.agg(F.sum("n"), F.sum("sum"), F.max("n")).first()
        if (n, total) == before or not n:
            break
        before, bound = (n, total), max(1000, n // 200)
        hubs = low.where(F.col("n") > bound).select("src") if most > bound else None
        large = with_least(both, low.select("src", F.least("src", "m").alias("m")), hubs)
        large = kept(large.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct(), 3)
        least = large.groupBy("src").agg(F.min("dst").alias("m"))  # no node has more edges than it had
        small = with_least(large, least, hubs).select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst")
        e = kept(small.unionByName(least.select("src", F.col("m").alias("dst"))).distinct(), 3)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.groupBy("src").agg(F.min("dst").alias("root")).select(F.col("src").alias("node"), "root")
