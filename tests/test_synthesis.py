"""Synthetic users at size: dealt out to tasks, never broadcast; lists of cells as bitmaps."""

from pyspark.sql import functions as F

from tracemill.operators import bitmaps, synthesis
from tracemill.stages import keep


def broadcast_parts(df):
    """The lines below each broadcast of the final plan of a table that was collected."""
    lines, out = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].split("\n"), []
    depth = lambda s: len(s) - len(s.lstrip(" :+-"))
    for i, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = []
            for x in lines[i + 1 :]:
                if depth(x) <= depth(line):
                    break
                below.append(x)
            out.append("\n".join(below))
    return out


def test_synthetic_users_are_not_broadcast(spark):
    """Spark takes 40,000 users exploded from one row, and their visits, for one row."""
    rois = keep(spark.range(20).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("roi"), F.lit(0.05).alias("p"), F.lit(5.0).alias("mean")))
    times = keep(spark.range(6).select(F.lit(1).alias("k"), F.col("id").cast("int").alias("epoch"), (F.lit(1.0) / 6).alias("p")))
    near = spark.range(19).select(F.col("id").cast("int").alias("roi"), (F.col("id") + 1).cast("int").alias("nbr"))
    made = synthesis.traces_at(rois, times, near, ["k"], 40_000, cluster_size=4)
    rows = made.collect()
    assert len(rows) == len(set(rows)) and len({r.user_id for r in rows}) > 30_000
    assert not [p for p in broadcast_parts(made) if "user_id" in p]


def test_users_of_one_row_are_many_tasks(spark):
    got = synthesis.users(spark.range(1).withColumnRenamed("id", "k"), ["k"], 50_001)
    assert got.rdd.getNumPartitions() == 4
    assert got.agg(F.min("user_id"), F.max("user_id"), F.countDistinct("user_id")).first()[:] == (-50_001, -1, 50_001)


def test_lists_of_cells_give_the_bitmaps_of_rows(spark):
    rows = [(1, 0, 0), (1, 700, 99), (1, 3000, 5), (2, 700, 99), (-3, 655, 36)]  # 655 * 100 + 36 is the first cell of the second chunk
    cells = spark.createDataFrame(rows, "user_id long, roi int, epoch int")
    lists = cells.groupBy("user_id").agg(F.collect_set(F.col("roi").cast("long") * synthesis.WIDE + F.col("epoch")).alias("cells"))
    want, got = (sorted((r.user_id, r.chunk, bytes(r.bits)) for r in x.collect()) for x in (bitmaps.of_traces(cells, 100), bitmaps.of_lists(lists, 100, ["user_id"])))
    assert got == want
    assert sorted(map(tuple, synthesis.opened(lists).collect())) == sorted(rows)
