"""The registered queries over the `events` table, and the SQL that gives the same rows.

Visits are events with the ROI from their property and epochs of a day; ROIs and epochs are as many as the data has. Groups of
single queries are small, so that the smallest table has enough users; bundles and audits grow with the number of users, up to
the published sizes. Numbers that come from different arithmetic are rounded the same way on both sides.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import AuditConfig, BuildConfig, sweep
from .functions import draws
from .functions.spatial import Box, haversine
from .functions.temporal import as_text, observation_window
from .operators import adjacency, aggregates, bitmaps, classify, growth, marginals, metrics, partial, prep, privacy, rules, sampling, synthesis
from .plans import audit, build
from .sources import readers, sinks
from .stages import keep, new_path
from .streaming import release as streaming

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 86400
M, TARGETS, PAIRS = 8, 3, 4  # group size, targets, groups
STOP = 1705276800
BOX = Box(9.1, 9.27, 45.4, 45.53, 1.6)



def build_config(n_users: int) -> BuildConfig:
    """A bundle for so many users: the published sizes, or what the users suffice for."""
    reference = max(min(12, n_users // 2), min(2500, n_users // 10))
    m = min(max(M, min(1000, n_users // 40)), max(1, reference - 1), max(1, n_users - reference))
    return BuildConfig(group_size=m, n_targets=max(TARGETS, min(50, n_users // 300)), min_visits=10, reference_size=reference, train=16, test=8, validation=8, seed=42)


def audit_config(n_users: int, **changed: object) -> AuditConfig:
    """An audit of that bundle."""
    b = build_config(n_users)
    return AuditConfig(group_size=b.group_size, n_targets=b.n_targets, train_size=b.train, validation_size=b.validation, n_groups=b.test, n_synthetic=5 * b.group_size, cluster_size=5, seed=2023, **changed)


#: An audit of single groups of size M.
SMALL = AuditConfig(group_size=M, n_targets=None, train_size=16, validation_size=8, n_groups=8, n_synthetic=40, cluster_size=5, seed=2023)


def query(oracle: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle.replace("WITH ", "WITH RECURSIVE ", 1) if oracle.startswith("WITH ") else oracle
        return f

    return add


def u(*parts: str) -> str:
    """SQL for draws.uniform: parts are SQL expressions."""
    return f"((CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)::DOUBLE + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"


POINTS_SQL = """points AS (SELECT event_id, user_id + 1 AS user_id, epoch_us(ts) // 1000000 AS ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, value,
  9.08::DOUBLE + 0.002::DOUBLE * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + 0.00001::DOUBLE * value AS lon,
  45.39::DOUBLE + 0.0015::DOUBLE * CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) + 0.00001::DOUBLE * value AS lat FROM events)"""
VISITS_SQL = POINTS_SQL + """, w AS (SELECT min(ts) AS t0 FROM points),
visits AS (SELECT event_id, user_id, ts, k AS roi, CAST(trunc((86400.0::DOUBLE * floor(ts / 86400.0::DOUBLE) - t0) / 86400.0::DOUBLE) AS INT) AS epoch FROM points, w)"""
ROIS_SQL, EPOCHS_SQL = ("(SELECT unnest(range(CAST(max(roi) + 1 AS BIGINT))) AS r FROM traces)", "(SELECT unnest(range(CAST(max(epoch) + 1 AS BIGINT))) AS e FROM traces)")
TRACES_SQL = VISITS_SQL + ", traces AS (SELECT DISTINCT user_id, roi, epoch FROM visits), sizes AS (SELECT user_id, count(*) AS n_visits FROM traces GROUP BY 1)"
TARGETS_SQL = TRACES_SQL + f", targets AS (SELECT user_id AS target FROM sizes WHERE n_visits >= 10 ORDER BY {u(chr(39) + 'target' + chr(39), '42', 'user_id')}, user_id LIMIT {TARGETS})"


def permuted_sql(name: str, source: str, kept: str, place: str, n: str, *key: str) -> str:
    """SQL for permute.permuted: rows `kept` of a source with the value `v`, a round of the network for each step of a recursion."""

    def mix(digit: str) -> str:
        k = "CAST('0x' || substr(h, 3 * (step % 8) + 1, 3) AS BIGINT)"
        t = f"(({digit} + {k} * 2053 + 1) % 2147483647)"
        return f"(((({t} * {t} + {k}) % 2147483647) * 48271 + 11) % 2147483647)"

    return f"""{name}_w AS (SELECT {kept}, h, n, a, (n + a - 1) // a AS b, place // ((n + a - 1) // a) AS l, place % ((n + a - 1) // a) AS r, CAST(0 AS BIGINT) AS step
  FROM (SELECT {kept}, CAST({place} AS BIGINT) AS place, CAST({n} AS BIGINT) AS n, CAST(ceil(sqrt(CAST({n} AS DOUBLE))) AS BIGINT) AS a, md5(concat_ws('|', {', '.join(key)})) AS h FROM {source})
 UNION ALL SELECT {kept}, h, n, a, b, CASE WHEN step % 2 = 0 THEN (l + {mix('r')}) % a ELSE l END, CASE WHEN step % 2 = 1 THEN (r + {mix('l')}) % b ELSE r END, step + 1 FROM {name}_w WHERE step = 0 OR step % 8 <> 0 OR l * b + r >= n),
{name} AS (SELECT {kept}, l * b + r AS v FROM {name}_w WHERE step > 0 AND step % 8 = 0 AND l * b + r < n)"""


def dealt_sql(name: str, source: str, kept: str) -> str:
    """SQL for sampling.Dealt.at: rows (target, kept, v) of a source with the user at place v among the others of the target."""
    return permuted_sql(f"{name}_o", f"{source}, nu", kept, "v", "n_users - 1", "'others'", "42", "target") + f""",
{name} AS (SELECT {', '.join('o.' + c.strip() for c in kept.split(','))}, n.user_id FROM {name}_o o JOIN own USING (target) JOIN numbered n ON n.number = o.v + CASE WHEN o.v >= own.number THEN 1 ELSE 0 END)"""


POOL_SQL = TARGETS_SQL + """, numbered AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS number FROM sizes), nu AS (SELECT count(*) AS n_users FROM sizes), own AS (SELECT user_id AS target, number FROM numbered WHERE user_id IN (SELECT target FROM targets))"""
PAIRED_SQL = POOL_SQL + f""", pask AS (SELECT target, pair, nth, n_users FROM targets, nu, (SELECT unnest(range({PAIRS // 2})) AS pair), (SELECT unnest(range({M})) AS nth)),
{permuted_sql('pplace', 'pask', 'target, pair, nth', 'nth', 'n_users - 1', "'train'", '42', 'target', 'pair')},
{dealt_sql('pr', 'pplace', 'target, pair, nth')},
paired AS (SELECT target, target || '-train-' || pair AS pair_id, CASE WHEN nth < {M - 1} THEN 'common' ELSE 'out' END AS role, user_id FROM pr
 UNION ALL SELECT target, target || '-train-' || pair, 'in', target FROM pr WHERE nth = {M - 1})"""
GROUPED_SQL = POOL_SQL + f""", gask AS (SELECT target, grp, nth, n_users FROM targets, nu, (SELECT unnest(range({PAIRS})) AS grp), (SELECT unnest(range({M})) AS nth)),
{permuted_sql('gplace', 'gask', 'target, grp, nth', 'nth', 'n_users - 1', "'test'", '42', 'target', 'grp')},
{dealt_sql('gr', 'gplace', 'target, grp, nth')},
grouped AS (SELECT target, target || '-test-' || grp AS agg_id, CASE WHEN grp < {PAIRS // 2} THEN 1 ELSE 0 END AS label, CASE WHEN grp < {PAIRS // 2} AND nth = {M - 1} THEN target ELSE user_id END AS user_id FROM gr)"""
PAIRCNT_SQL = PAIRED_SQL + """, pairmem AS (SELECT target, pair_id, label, user_id FROM paired, (SELECT unnest([0, 1]) AS label) WHERE role = 'common' OR (role = 'in') = (label = 1)),
paircnt AS (SELECT target, pair_id, label, roi, epoch, count(*) AS cnt FROM pairmem JOIN traces USING (user_id) GROUP BY ALL)"""
GROUPS_SQL = GROUPED_SQL + """,
cnts AS (SELECT target, agg_id, label, roi, epoch, count(*) AS cnt FROM grouped JOIN traces USING (user_id) GROUP BY ALL)"""


def grid_size(spark: SparkSession, sf_dir: str) -> tuple[int, int]:
    """How many ROIs and epochs the visits have, from one row."""
    d = readers.dims(cells(spark, sf_dir)).first()
    return int(d["n_rois"] or 0), int(d["n_epochs"] or 0)


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.event_points(spark.read.parquet(f"{sf_dir}/events.parquet"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.with_epoch(points(spark, sf_dir).withColumn("roi", F.col("k")), DAY).select("event_id", "user_id", "ts", "roi", "epoch")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prep.traces(visits(spark, sf_dir))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.targets(prep.sizes(cells(spark, sf_dir)), TARGETS, 10)


def pool(spark: SparkSession, sf_dir: str) -> sampling.Dealt:
    return sampling.everyone(targets(spark, sf_dir), prep.sizes(cells(spark, sf_dir)))


def paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.groups_paired(pool(spark, sf_dir), "train", M, PAIRS)


def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.groups(pool(spark, sf_dir), "test", M, PAIRS)


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregates.group_counts(grouped(spark, sf_dir), cells(spark, sf_dir), ["target", "agg_id", "label"])


def target_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, t = cells(spark, sf_dir), targets(spark, sf_dir)
    return t.join(c, t["target"] == c["user_id"]).select("target", "roi", "epoch")


# Sources, windows, filters, grid


@query("WITH " + POINTS_SQL + " SELECT event_id, user_id, ts, k, lon, lat FROM points")
def visits_ingest(spark, sf_dir):
    return points(spark, sf_dir)


@query("WITH " + POINTS_SQL + " SELECT min(ts) AS min_ts, max(ts) AS max_ts, CAST(trunc((max(ts) - min(ts)) / 3600.0::DOUBLE) AS BIGINT) + 1 AS n_epochs FROM points")
def observation_period(spark, sf_dir):
    return observation_window(points(spark, sf_dir), 3600)


@query("WITH " + POINTS_SQL + f" SELECT event_id, user_id, ts FROM points WHERE ts < {STOP} AND lon > 9.1 AND lon < 9.27 AND lat > 45.4 AND lat < 45.53")
def time_box_filter(spark, sf_dir):
    return prep.trim(points(spark, sf_dir), BOX, STOP).select("event_id", "user_id", "ts")


@query("WITH " + VISITS_SQL + " SELECT event_id, user_id, roi, epoch FROM visits")
def epoch_bin(spark, sf_dir):
    return visits(spark, sf_dir).select("event_id", "user_id", "roi", "epoch")


@query("WITH " + POINTS_SQL + ", w AS (SELECT min(ts) AS t0 FROM points) SELECT event_id, CAST(trunc((3600.0::DOUBLE * floor(ts / 3600.0::DOUBLE) - 3600.0::DOUBLE * floor(t0 / 3600.0::DOUBLE)) / 3600.0::DOUBLE) AS INT) AS epoch FROM points, w")
def epoch_bin_aligned(spark, sf_dir):
    return prep.with_epoch(points(spark, sf_dir), 3600, align=True).select("event_id", "epoch")


@query("WITH " + POINTS_SQL + " SELECT event_id, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS at FROM points")
def unix_text(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", as_text(F.col("ts")).alias("at"))


@query("WITH " + POINTS_SQL + """ SELECT round(quantile_cont(lon, 0.005), 6) AS min_lon, round(quantile_cont(lon, 0.995), 6) AS max_lon, round(quantile_cont(lat, 0.005), 6) AS min_lat, round(quantile_cont(lat, 0.995), 6) AS max_lat,
 round(min(lon), 6) AS least_lon, round(max(lon), 6) AS most_lon, round(min(lat), 6) AS least_lat, round(max(lat), 6) AS most_lat FROM points""")
def percentile_box(spark, sf_dir):
    box = prep.percentile_box(points(spark, sf_dir))
    return box.select(*(F.round(c, 6).alias(c) for c in box.columns))


def km(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    return f"(2.0::DOUBLE * 6371.0::DOUBLE * asin(sqrt(pow(sin((radians({lat2}) - radians({lat1})) / 2.0::DOUBLE), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2.0::DOUBLE), 2))))"


def d(x: float) -> str:
    return f"{x}::DOUBLE"


WIDTH = km(d(9.1), d(45.4), d(9.27), d(45.4))
HEIGHT = km(d(9.1), d(45.4), d(9.1), d(45.53))


@query("WITH " + POINTS_SQL + f" SELECT event_id, round({km(d(9.1), d(45.4), 'lon', 'lat')}, 6) AS km FROM points")
def haversine_km(spark, sf_dir):
    return points(spark, sf_dir).select("event_id", F.round(haversine(9.1, 45.4, F.col("lon"), F.col("lat")), 6).alias("km"))


#: The box of the points' coordinates, and its sides.
OWN_BOX = POINTS_SQL + ", ob AS (SELECT round(min(lon), 6) AS x0, round(max(lon), 6) AS x1, round(min(lat), 6) AS y0, round(max(lat), 6) AS y1 FROM points)"
OWN_WIDTH, OWN_HEIGHT = km("x0", "y0", "x1", "y0"), km("x0", "y0", "x0", "y1")


def own_box(spark: SparkSession, sf_dir: str, cell_km: float = 1.6) -> Box:
    """The box that holds the points; four numbers are known here."""
    p = points(spark, sf_dir)
    x0, x1, y0, y1 = (float(v) for v in p.agg(*(F.round(f(c), 6) for c in ("lon", "lat") for f in (F.min, F.max))).first())
    return Box(x0, x1, y0, y1, cell_km)


@query("WITH " + OWN_BOX + f" SELECT round({OWN_WIDTH} * {OWN_HEIGHT}, 6) AS area, CAST(floor({OWN_WIDTH} * {OWN_HEIGHT} / (1.6::DOUBLE * 1.6::DOUBLE)) AS BIGINT) + 1 AS n_rois, CAST(floor({OWN_WIDTH} / 1.6::DOUBLE) AS BIGINT) AS n_columns FROM ob")
def grid_area_rois(spark, sf_dir):
    p = points(spark, sf_dir).agg(*(F.round(f(c), 6).alias(n) for n, c, f in (("x0", "lon", F.min), ("x1", "lon", F.max), ("y0", "lat", F.min), ("y1", "lat", F.max))))
    box = Box(F.col("x0"), F.col("x1"), F.col("y0"), F.col("y1"), 1.6)
    return p.select(F.round(box.area(), 6).alias("area"), box.n_cells().alias("n_rois"), box.n_columns().alias("n_columns"))


@query("WITH " + POINTS_SQL + f""" SELECT event_id, CAST(floor({WIDTH} / 1.6::DOUBLE) * floor({km(d(9.1), d(45.4), d(9.1), 'lat')} / 1.6::DOUBLE) + floor({km(d(9.1), d(45.4), 'lon', d(45.4))} / 1.6::DOUBLE) + 1 AS INT) AS roi
 FROM points WHERE lon > 9.1 AND lon < 9.27 AND lat > 45.4 AND lat < 45.53""")
def grid_cell(spark, sf_dir):
    return prep.grid(prep.trim(points(spark, sf_dir), BOX), BOX).select("event_id", "roi")


@query("WITH " + OWN_BOX + f""", sz AS (SELECT *, CAST(floor({OWN_WIDTH} / 0.4::DOUBLE) AS BIGINT) AS nl, CAST(floor({OWN_WIDTH} * {OWN_HEIGHT} / (0.4::DOUBLE * 0.4::DOUBLE)) AS BIGINT) + 1 AS n FROM ob), g AS (SELECT *, CAST(unnest(range(1, n + 1)) AS INT) AS roi FROM sz)
 SELECT roi, round(greatest(x0 + 1e-10::DOUBLE, least(x0 + ((roi - 1) % nl + 0.5::DOUBLE) * 0.4::DOUBLE / {km("x0", "y0", "x0 + 1.0::DOUBLE", "y0")}, x1 - 1e-10::DOUBLE)), 6) AS lon,
 round(greatest(y0 + 1e-10::DOUBLE, least(y0 + ((roi - 1) // nl + 0.5::DOUBLE) * 0.4::DOUBLE / {km("x0", "y0", "x0", "y0 + 1.0::DOUBLE")}, y1 - 1e-10::DOUBLE)), 6) AS lat FROM g""")
def grid_centroids(spark, sf_dir):
    """Middles of the cells of the points' box, 400 m wide."""
    box = own_box(spark, sf_dir, 0.4)
    n = spark.range(1).select(box.n_cells()).first()[0]
    return box.centroids(spark, n).select("roi", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"))


# Relabelling and regular users


@query("WITH " + VISITS_SQL + " SELECT roi, row_number() OVER (ORDER BY min(event_id), roi) - 1 AS idx FROM visits GROUP BY roi")
def first_seen_relabel(spark, sf_dir):
    return prep.first_seen(visits(spark, sf_dir), "roi", "event_id")


@query("WITH " + VISITS_SQL + " SELECT user_id, row_number() OVER (ORDER BY user_id) AS new_id FROM (SELECT DISTINCT user_id FROM visits)")
def contiguous_users(spark, sf_dir):
    return prep.contiguous_users(visits(spark, sf_dir))


@query("WITH " + VISITS_SQL + f" SELECT roi, row_number() OVER (ORDER BY {u(chr(39) + 'shuffle' + chr(39), '2023', 'roi')}, roi) - 1 AS idx FROM (SELECT DISTINCT roi FROM visits)")
def shuffled_relabel(spark, sf_dir):
    return prep.shuffled_labels(visits(spark, sf_dir), "roi", draws.uniform("shuffle", 2023, F.col("roi")))


@query("WITH " + VISITS_SQL + " , m AS (SELECT roi, row_number() OVER (ORDER BY min(event_id), roi) - 1 AS idx FROM visits WHERE roi < 60 GROUP BY roi) SELECT event_id, user_id, ts, idx AS roi, epoch FROM visits JOIN m USING (roi)")
def relabelled_visits(spark, sf_dir):
    v = visits(spark, sf_dir)
    return prep.relabel(v, prep.first_seen(v.where("roi < 60"), "roi", "event_id"), "roi")


REGION_SQL = "st AS (SELECT user_id, count(*) AS n_visits, count_if(roi < 45) AS n_inside, count(DISTINCT CASE WHEN roi < 45 THEN roi END) AS n_rois FROM visits GROUP BY 1)"


def region(spark):
    return spark.range(45).select(F.col("id").cast("int").alias("roi"))


@query("WITH " + VISITS_SQL + ", " + REGION_SQL + " SELECT user_id, n_visits, CAST(n_inside AS BIGINT) AS n_inside, n_rois FROM st WHERE n_inside >= 0.5 * n_visits")
def valid_users(spark, sf_dir):
    return prep.regular_users(visits(spark, sf_dir), region(spark))


@query("WITH " + VISITS_SQL + ", " + REGION_SQL + " SELECT count(*) AS n_users, CAST(count_if(n_inside >= 0.5 * n_visits) AS BIGINT) AS n_valid, round(avg(CASE WHEN n_inside >= 0.5 * n_visits THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS share_valid FROM st")
def setting_stats(spark, sf_dir):
    return prep.setting_stats(visits(spark, sf_dir), region(spark)).withColumn("share_valid", F.round("share_valid", 9))


@query("WITH " + VISITS_SQL + ", " + REGION_SQL + ", ok AS (SELECT user_id FROM st WHERE n_inside >= 0.5 * n_visits) SELECT event_id, user_id, ts, roi, epoch FROM visits SEMI JOIN ok USING (user_id) WHERE roi < 45")
def filtered_setting(spark, sf_dir):
    v = visits(spark, sf_dir)
    return prep.restrict(v, prep.regular_users(v, region(spark)), region(spark))


@query("WITH " + TRACES_SQL + " SELECT CAST(max(roi) + 1 AS BIGINT) AS n_rois, CAST(max(epoch) + 1 AS BIGINT) AS n_epochs, count(DISTINCT user_id) AS n_users FROM traces")
def dims(spark, sf_dir):
    return readers.dims(cells(spark, sf_dir))


# Traces


@query("WITH " + TRACES_SQL + " SELECT user_id, roi, epoch FROM traces")
def user_traces(spark, sf_dir):
    return cells(spark, sf_dir)


@query("WITH " + TRACES_SQL + " SELECT user_id, n_visits FROM sizes")
def trace_sizes(spark, sf_dir):
    return prep.sizes(cells(spark, sf_dir))


@query("WITH " + TRACES_SQL + " SELECT n_visits, count(*) AS n_users FROM sizes GROUP BY 1")
def activity_hist(spark, sf_dir):
    return prep.activity(cells(spark, sf_dir))


@query("WITH " + TRACES_SQL + ", r AS (SELECT user_id, n_visits, row_number() OVER (ORDER BY n_visits DESC, user_id) - 1 AS i, ceil(count(*) OVER () / 4.0) AS b FROM sizes) SELECT user_id, n_visits, CAST(floor(i / b) AS BIGINT) AS block FROM r")
def users_by_size_blocks(spark, sf_dir):
    return prep.size_blocks(cells(spark, sf_dir), 4)


# Sampling


@query("WITH " + TARGETS_SQL + " SELECT target FROM targets")
def sample_targets(spark, sf_dir):
    return targets(spark, sf_dir)


@query("WITH " + TRACES_SQL + f""", r AS (SELECT user_id, row_number() OVER (ORDER BY n_visits DESC, user_id) - 1 AS i, ceil(count(*) OVER () / 4.0) AS b FROM sizes), s AS (SELECT user_id, CAST(floor(i / b) AS BIGINT) AS block FROM r)
 SELECT user_id AS target, block FROM s QUALIFY row_number() OVER (PARTITION BY block ORDER BY {u("'stratum'", '42', 'user_id')}, user_id) <= 2""")
def sample_targets_strata(spark, sf_dir):
    return sampling.targets_by_stratum(prep.size_blocks(cells(spark, sf_dir), 4), 2)


REFERENCE_SQL = POOL_SQL + f""", rask AS (SELECT target, unnest(range(n_users - 1)) AS v FROM targets, nu), rp AS (SELECT target, v, v AS place FROM rask), {dealt_sql('rr', 'rp', 'target, place')}"""


@query("WITH " + REFERENCE_SQL + " SELECT target, user_id, place < 9 AS in_reference FROM rr UNION ALL SELECT target, target, true FROM targets")
def sample_reference(spark, sf_dir):
    """Everybody, by target: its reference of 10 with itself, and the rest."""
    t = targets(spark, sf_dir)
    inside, rest = sampling.reference(t, prep.sizes(cells(spark, sf_dir)), 10)
    own = t.select("target", F.col("target").alias("user_id"))
    return inside.listed().unionByName(own).withColumn("in_reference", F.lit(True)).unionByName(rest.listed().withColumn("in_reference", F.lit(False)))


STATIC = f"""static AS (SELECT user_id FROM sizes ORDER BY {u("'static'", '42', 'user_id')}, user_id LIMIT 10)"""


@query("WITH " + TRACES_SQL + ", " + STATIC + " SELECT user_id FROM static")
def sample_reference_static(spark, sf_dir):
    return sampling.reference_static(prep.sizes(cells(spark, sf_dir)), 10)


@query("WITH " + TARGETS_SQL + ", " + STATIC + f""", o AS (SELECT target, user_id, max(CASE WHEN user_id = target THEN 1 ELSE 0 END) OVER (PARTITION BY target) AS there,
 row_number() OVER (PARTITION BY target ORDER BY {u("'evict'", '42', 'target', 'user_id')}, user_id) AS r FROM targets, static)
 SELECT target, CASE WHEN there = 0 AND r = 1 THEN target ELSE user_id END AS user_id FROM o""")
def include_target(spark, sf_dir):
    return sampling.include_target(sampling.reference_static(prep.sizes(cells(spark, sf_dir)), 10), targets(spark, sf_dir))


@query("WITH " + PAIRED_SQL + " SELECT target, pair_id, role, user_id FROM paired")
def groups_paired(spark, sf_dir):
    return paired(spark, sf_dir).drop("split")


@query("WITH " + GROUPS_SQL + " SELECT target, agg_id, label, user_id FROM grouped")
def groups_unpaired(spark, sf_dir):
    return grouped(spark, sf_dir).drop("split")


@query("WITH " + GROUPS_SQL + f""", a AS (SELECT DISTINCT target, label, agg_id FROM cnts) SELECT target, label, agg_id FROM a QUALIFY row_number() OVER (PARTITION BY target, label ORDER BY {u("'sub'", '42', 'agg_id')}, agg_id) <= 1""")
def subsample_aggs(spark, sf_dir):
    return sampling.subsample(counts(spark, sf_dir), 1)


@query("WITH " + PAIRCNT_SQL + """, a AS (SELECT DISTINCT target, label, pair_id FROM paircnt) SELECT target, label, pair_id, pair_id || '-' || label AS agg_id FROM a QUALIFY row_number() OVER (PARTITION BY target, label ORDER BY pair_id) <= 1""")
def first_pairs(spark, sf_dir):
    return sampling.first_pairs(sampling.members(paired(spark, sf_dir)), 1)


# Aggregates and disclosure control


@query("WITH " + GROUPS_SQL + " SELECT target, agg_id, label, roi, epoch, cnt FROM cnts")
def agg_group(spark, sf_dir):
    return counts(spark, sf_dir)


@query("WITH " + PAIRCNT_SQL + " SELECT target, pair_id, label, roi, epoch, cnt FROM paircnt")
def agg_paired(spark, sf_dir):
    return aggregates.pair_counts(paired(spark, sf_dir), cells(spark, sf_dir)).drop("split").withColumn("cnt", F.col("cnt").cast("long"))


TCELLS = "tc AS (SELECT user_id AS target, roi, epoch FROM traces WHERE user_id IN (SELECT target FROM targets))"
RANDOM_PART = f"""kn AS (SELECT target, roi, epoch FROM (SELECT target, roi, epoch, row_number() OVER (PARTITION BY target ORDER BY {u("'part'", '42', 'target', 'roi', 'epoch')}, roi, epoch) AS r, count(*) OVER (PARTITION BY target) AS n FROM tc) WHERE r > CAST(trunc(n * (1.0::DOUBLE - 0.25::DOUBLE)) AS INT))"""


@query("WITH " + PAIRCNT_SQL + ", " + TCELLS + ", " + RANDOM_PART + """, gs AS (SELECT DISTINCT target, pair_id, label FROM paircnt WHERE label = 1),
 s AS (SELECT target, pair_id, label, roi, epoch, cnt FROM paircnt UNION ALL SELECT target, pair_id, label, roi, epoch, -1 FROM gs JOIN tc USING (target) UNION ALL SELECT target, pair_id, label, roi, epoch, 1 FROM gs JOIN kn USING (target))
 SELECT target, pair_id, label, roi, epoch, CAST(sum(cnt) AS BIGINT) AS cnt FROM s GROUP BY ALL HAVING sum(cnt) <> 0""")
def agg_signed_delta(spark, sf_dir):
    full = target_cells(spark, sf_dir)
    return aggregates.swap_traces(aggregates.pair_counts(paired(spark, sf_dir), cells(spark, sf_dir)), full, partial.random_part(full, 0.25), ["target", "pair_id", "label"])


@query("WITH " + GROUPS_SQL + " SELECT target, agg_id, label, roi, epoch, cnt FROM cnts WHERE cnt > 1")
def privacy_suppress(spark, sf_dir):
    return privacy.suppress(counts(spark, sf_dir), 1)


def noisy_sql(source: str, keys: str, noise: list[str], scale: float, k: int) -> str:
    skips, n = privacy.Skips(scale, k, 1 << 40), ", ".join(noise)
    x, skip, tail = (u(f"'{kind}'", "42", *noise, *at) for kind, at in (("noise", ("roi", "epoch")), ("skip", ("b", "i")), ("tail", ("b", "i"))))
    mean = f"(least({skips.block}, n_cells) * {skips.p!r}::DOUBLE)"
    return f""", ids AS (SELECT DISTINCT {keys} FROM {source}), grid AS (SELECT CAST(max(epoch) + 1 AS BIGINT) AS n_epochs, CAST((max(roi) + 1) * (max(epoch) + 1) AS BIGINT) AS n_cells FROM traces),
 counted AS (SELECT DISTINCT {n}, roi, epoch FROM {source}),
 dr AS (SELECT {keys}, roi, epoch, coalesce(cnt, 0) AS cnt, {x} AS u FROM (SELECT {keys}, roi, epoch FROM ids JOIN counted USING ({n})) LEFT JOIN {source} USING ({keys}, roi, epoch)),
 rel AS (SELECT {keys}, roi, epoch, CAST(greatest(0, least({M}, cnt + CAST(trunc(-{scale}::DOUBLE * sign(u - 0.5::DOUBLE) * ln(1.0::DOUBLE - 2.0::DOUBLE * abs(u - 0.5::DOUBLE))) AS BIGINT))) AS BIGINT) AS cnt FROM dr),
 sk0 AS (SELECT {n}, n_cells, n_epochs, unnest(range((n_cells - 1) // {skips.block} + 1)) AS b FROM (SELECT DISTINCT {n} FROM ids), grid),
 sk1 AS (SELECT *, unnest(range(CAST(ceil({mean} + 8.0::DOUBLE * sqrt({mean}) + 32.0::DOUBLE) AS BIGINT))) AS i FROM sk0),
 sk2 AS (SELECT *, sum(CAST(floor(ln({skip}) / {math.log(1.0 - skips.p)!r}::DOUBLE) AS BIGINT) + 1) OVER (PARTITION BY {n}, b ORDER BY i) - 1 AS pos FROM sk1),
 sk3 AS (SELECT {n}, CAST((b * {skips.block} + pos) // n_epochs AS INT) AS roi, CAST((b * {skips.block} + pos) % n_epochs AS INT) AS epoch, CAST(trunc(-{scale}::DOUBLE * ln(1.0::DOUBLE - {tail})) AS BIGINT) + {k + 1} AS z FROM sk2 WHERE pos < {skips.block} AND b * {skips.block} + pos < n_cells),
 risen AS (SELECT {keys}, roi, epoch, CAST(least({M}, z) AS BIGINT) AS cnt FROM ids JOIN (SELECT * FROM sk3 ANTI JOIN counted USING ({n}, roi, epoch)) USING ({n}))
 SELECT {keys}, roi, epoch, cnt FROM rel WHERE cnt > {k} UNION ALL SELECT {keys}, roi, epoch, cnt FROM risen WHERE cnt > {k}"""


@query("WITH " + GROUPS_SQL + noisy_sql("cnts", "target, agg_id, label", ["agg_id"], 1.0, 0))
def privacy_laplace(spark, sf_dir):
    c = keep(counts(spark, sf_dir))
    return privacy.release(c, c, ["target", "agg_id", "label"], ["agg_id"], *grid_size(spark, sf_dir), M, 1.0, 1.0)


@query("WITH " + PAIRCNT_SQL + noisy_sql("paircnt", "target, pair_id, label", ["pair_id"], 2.0, 0))
def privacy_pair(spark, sf_dir):
    c = keep(aggregates.pair_counts(paired(spark, sf_dir), cells(spark, sf_dir)))
    return privacy.release(c, c, ["target", "pair_id", "label"], ["pair_id"], *grid_size(spark, sf_dir), M, 0.5, 1.0)


@query("WITH " + GROUPS_SQL + noisy_sql("cnts", "target, agg_id, label", ["agg_id"], 2.0, 2))
def privacy_full(spark, sf_dir):
    c = keep(counts(spark, sf_dir))
    return privacy.release(c, c, ["target", "agg_id", "label"], ["agg_id"], *grid_size(spark, sf_dir), M, 0.5, 1.0, k=2)


# Marginals and activity


@query("WITH " + GROUPS_SQL + " SELECT agg_id, roi, CAST(sum(cnt) AS BIGINT) AS total, round(sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY agg_id), 9) AS p FROM cnts GROUP BY agg_id, roi")
def marg_roi(spark, sf_dir):
    return marginals.marginal(counts(spark, sf_dir), "roi", ["agg_id"]).withColumn("p", F.round("p", 9))


@query("WITH " + GROUPS_SQL + " SELECT agg_id, epoch, CAST(sum(cnt) AS BIGINT) AS total, round(sum(cnt) / sum(sum(cnt)) OVER (PARTITION BY agg_id), 9) AS p FROM cnts GROUP BY agg_id, epoch")
def marg_epoch(spark, sf_dir):
    return marginals.marginal(counts(spark, sf_dir), "epoch", ["agg_id"]).withColumn("p", F.round("p", 9))


@query("WITH " + GROUPS_SQL + """, g AS (SELECT agg_id, CASE WHEN roi IS NOT NULL THEN 'roi' WHEN epoch IS NOT NULL THEN 'epoch' ELSE 'all' END AS axis, coalesce(roi, epoch, -1) AS idx, sum(cnt) AS total FROM cnts GROUP BY GROUPING SETS ((agg_id, roi), (agg_id, epoch), (agg_id)))
 SELECT agg_id, axis, idx, CAST(total AS BIGINT) AS total, round(total / max(total) OVER (PARTITION BY agg_id), 9) AS p FROM g""")
def marg_grouping_sets(spark, sf_dir):
    return marginals.marginals(counts(spark, sf_dir), ["agg_id"]).withColumn("p", F.round("p", 9))


MARG = ", mg AS (SELECT agg_id, roi, sum(cnt)::DOUBLE / (sum(sum(cnt)) OVER (PARTITION BY agg_id))::DOUBLE AS p FROM cnts GROUP BY agg_id, roi)"


@query("WITH " + GROUPS_SQL + MARG + ", l AS (SELECT agg_id, roi, ln(p / min(p) OVER (PARTITION BY agg_id) + 1.0::DOUBLE) AS p FROM mg) SELECT agg_id, roi, round(p / sum(p) OVER (PARTITION BY agg_id), 9) AS p FROM l")
def marg_log(spark, sf_dir):
    shares = marginals.marginal(counts(spark, sf_dir), "roi", ["agg_id"]).drop("total")
    return marginals.log_compressed(shares, ["agg_id"]).withColumn("p", F.round("p", 9))


@query("WITH " + GROUPS_SQL + MARG + ", l AS (SELECT agg_id, roi, pow(p, 0.001::DOUBLE) AS p FROM mg) SELECT agg_id, roi, round(p / sum(p) OVER (PARTITION BY agg_id), 9) AS p FROM l")
def marg_power(spark, sf_dir):
    shares = marginals.marginal(counts(spark, sf_dir), "roi", ["agg_id"]).drop("total")
    return marginals.powered(shares, ["agg_id"], 0.001).withColumn("p", F.round("p", 9))


@query("WITH " + GROUPS_SQL + MARG + f""", rd AS (SELECT {u("'power'", '42', "'roi'", 'i')} AS x FROM (SELECT r AS i FROM {ROIS_SQL}) t), rv AS (SELECT var_pop(x / s) AS v FROM rd, (SELECT sum(x) AS s FROM rd)), vs AS (SELECT agg_id, var_pop(p) AS variance FROM mg GROUP BY 1)
 SELECT agg_id, round(variance, 9) AS variance, CASE WHEN variance > 2.0::DOUBLE * v THEN 0.001::DOUBLE ELSE 0.0::DOUBLE END AS exponent FROM vs, rv""")
def power_exponent(spark, sf_dir):
    shares = marginals.marginal(counts(spark, sf_dir), "roi", ["agg_id"])
    return marginals.power_exponent(shares, ["agg_id"], marginals.reference_variance(grid_size(spark, sf_dir)[0], 42, "roi")).withColumn("variance", F.round("variance", 9))


USER_U = u("'activity'", "42", "user_id")


@query("WITH " + TRACES_SQL + f", m AS (SELECT avg(n_visits) AS mean FROM sizes) SELECT user_id, CAST(trunc(-mean * ln(1.0::DOUBLE - {USER_U})) AS BIGINT) AS n_visits FROM sizes, m")
def activity_exp_draws(spark, sf_dir):
    return _activity(spark, sf_dir, "exp")


@query("WITH " + TRACES_SQL + f", m AS (SELECT avg(n_visits) AS mean FROM sizes) SELECT user_id, CAST(trunc(pow(1.0::DOUBLE - {USER_U}, -1.0::DOUBLE / (1.0::DOUBLE + 1.0::DOUBLE / mean))) AS BIGINT) AS n_visits FROM sizes, m")
def activity_pareto_draws(spark, sf_dir):
    return _activity(spark, sf_dir, "powerlaw")


@query("WITH " + TRACES_SQL + ", m AS (SELECT avg(n_visits) AS mean FROM sizes) SELECT user_id, CAST(trunc(mean) AS BIGINT) AS n_visits FROM sizes, m")
def activity_constant(spark, sf_dir):
    return _activity(spark, sf_dir, "constant")


def _lognormal_sql() -> str:
    q = "(9.0::DOUBLE + sqrt(81.0::DOUBLE + 36.0::DOUBLE) + 2.0::DOUBLE)"
    return f"ln(pow({q} / 2.0::DOUBLE, 1.0::DOUBLE / 3.0::DOUBLE) + pow(2.0::DOUBLE / {q}, 1.0::DOUBLE / 3.0::DOUBLE) - 1.0::DOUBLE)"


@query("WITH " + TRACES_SQL + f", m AS (SELECT avg(n_visits) AS mean FROM sizes) SELECT round(sqrt({_lognormal_sql()}), 9) AS sigma, round(mean / exp({_lognormal_sql()} / 2.0::DOUBLE), 6) AS median FROM m")
def lognormal_params(spark, sf_dir):
    mean = prep.sizes(cells(spark, sf_dir)).agg(F.avg("n_visits").alias("mean"))
    sigma, median = marginals.lognormal_parameters(F.col("mean"), 3.0)
    return mean.select(F.round(F.lit(sigma), 9).alias("sigma"), F.round(median, 6).alias("median"))


@query("WITH " + TRACES_SQL + f""", m AS (SELECT avg(n_visits) AS mean FROM sizes) SELECT user_id, CAST(trunc(mean / exp({_lognormal_sql()} / 2.0::DOUBLE) * exp(sqrt({_lognormal_sql()}) * sqrt(-2.0::DOUBLE * ln({USER_U})) * cos(6.283185307179586::DOUBLE * {u("'activity2'", '42', 'user_id')}))) AS BIGINT) AS n_visits FROM sizes, m""")
def activity_lognormal_draws(spark, sf_dir):
    return _activity(spark, sf_dir, "lognormal")


def _activity(spark, sf_dir, kind):
    sizes = prep.sizes(cells(spark, sf_dir))
    with_mean = sizes.crossJoin(F.broadcast(sizes.agg(F.avg("n_visits").alias("mean"))))
    draw = marginals.activity_draw(kind, F.col("mean"), draws.uniform("activity", 42, F.col("user_id")), draws.uniform("activity2", 42, F.col("user_id")))
    return with_mean.select("user_id", draw.alias("n_visits"))


@query("WITH " + GROUPS_SQL + MARG + f""", c AS (SELECT agg_id, roi, sum(p) OVER (PARTITION BY agg_id ORDER BY roi) AS hi, row_number() OVER (PARTITION BY agg_id ORDER BY roi DESC) AS back FROM mg),
 b AS (SELECT agg_id, roi, CASE WHEN back = 1 THEN 2.0::DOUBLE ELSE hi END AS hi FROM c), dr AS (SELECT agg_id, i, {u("'draw'", '42', 'agg_id', 'i')} AS u FROM (SELECT DISTINCT agg_id FROM mg), range(50) t(i))
 SELECT agg_id, i, min(roi) AS roi FROM dr JOIN b USING (agg_id) WHERE hi > u GROUP BY ALL""")
def inv_cdf_draw(spark, sf_dir):
    shares = keep(marginals.marginal(counts(spark, sf_dir), "roi", ["agg_id"]))
    asked = shares.select("agg_id").distinct().withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long")))).withColumn("u", draws.uniform("draw", 42, F.col("agg_id"), F.col("i")))
    return synthesis.draw(asked, synthesis.cumulative(shares, "roi", ["agg_id"]), "roi", ["agg_id"]).select("agg_id", "i", "roi")


# Partial knowledge


@query("WITH " + TARGETS_SQL + ", " + TCELLS + ", " + RANDOM_PART + " SELECT target, roi, epoch FROM kn")
def partial_random(spark, sf_dir):
    return partial.known(target_cells(spark, sf_dir), "random", 0, share=0.25)


TOPK = "tops AS (SELECT target, roi, count(*) AS cnt FROM tc GROUP BY ALL), top AS (SELECT target, roi, cnt FROM tops QUALIFY row_number() OVER (PARTITION BY target ORDER BY cnt DESC, roi) <= 5)"


@query("WITH " + TARGETS_SQL + ", " + TCELLS + ", " + TOPK + " SELECT target, roi, epoch FROM tc SEMI JOIN top USING (target, roi)")
def partial_topk(spark, sf_dir):
    return partial.known(target_cells(spark, sf_dir), "time_and_top_k_locations", 0, k=5)


@query("WITH " + TARGETS_SQL + ", " + TCELLS + f" SELECT DISTINCT target, roi, CAST(e AS INT) AS epoch FROM tc, {EPOCHS_SQL} t")
def partial_roi_greedy(spark, sf_dir):
    return partial.known(target_cells(spark, sf_dir), "only_rois_greedy", grid_size(spark, sf_dir)[1])


@query("WITH " + TARGETS_SQL + ", " + TCELLS + ", " + TOPK + f" SELECT target, roi, CAST(e AS INT) AS epoch FROM top, {EPOCHS_SQL} t")
def partial_roi_topk(spark, sf_dir):
    return partial.known(target_cells(spark, sf_dir), "only_rois_top_k_locations", grid_size(spark, sf_dir)[1], k=5)


# Rule and metrics


@query("WITH " + GROUPS_SQL + ", " + TCELLS + f""", gs AS (SELECT DISTINCT target, agg_id FROM grouped), miss AS (SELECT target, agg_id FROM gs JOIN tc USING (target) ANTI JOIN cnts USING (target, agg_id, roi, epoch)),
 everyone AS (SELECT target, agg_id, roi, epoch FROM cnts WHERE cnt = {M}), absent AS (SELECT target, agg_id FROM everyone ANTI JOIN tc USING (target, roi, epoch)), hit AS (SELECT * FROM miss UNION SELECT * FROM absent)
 SELECT target, agg_id, (target, agg_id) IN (SELECT (target, agg_id) FROM hit) AS contradiction FROM gs""")
def contradiction_rule(spark, sf_dir):
    groups = keep(grouped(spark, sf_dir).select("target", "agg_id").distinct())
    return rules.contradicted(groups, keep(counts(spark, sf_dir)), target_cells(spark, sf_dir), M)


PRED = f"""pr AS (SELECT user_id % 7 AS target, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS y, round({u("'score'", 'event_id')} + CASE WHEN event_type = 'view' THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END, 2) AS p FROM events)"""


def _predictions(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    p = F.round(draws.uniform("score", F.col("event_id")) + F.when(F.col("event_type") == "view", 0.2).otherwise(0.0), 2)
    return e.select((F.col("user_id") % 7).alias("target"), F.col("event_type").isin("click", "view").cast("int").alias("y"), p.alias("p")).withColumn("pred", (F.col("p") >= 0.5).cast("int"))


@query("WITH " + PRED + " SELECT target, round(avg(CASE WHEN y = (CASE WHEN p >= 0.5 THEN 1 ELSE 0 END) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS acc FROM pr GROUP BY 1")
def accuracy(spark, sf_dir):
    return metrics.accuracy(_predictions(spark, sf_dir), ["target"]).withColumn("acc", F.round("acc", 9))


@query("WITH " + PRED + """, r AS (SELECT target, y, rank() OVER (PARTITION BY target ORDER BY p) + (count(*) OVER (PARTITION BY target, p) - 1) / 2.0::DOUBLE AS r FROM pr), s AS (SELECT target, sum(CASE WHEN y = 1 THEN r ELSE 0 END) AS rs, count_if(y = 1)::DOUBLE AS np, count_if(y = 0)::DOUBLE AS nn FROM r GROUP BY 1)
 SELECT target, round((rs - np * (np + 1) / 2) / (np * nn), 9) AS auc FROM s""")
def auc(spark, sf_dir):
    return metrics.auc(_predictions(spark, sf_dir), ["target"]).withColumn("auc", F.round("auc", 9))


@query("WITH " + PRED + """, s AS (SELECT target, p, count_if(y = 1) AS pos, count_if(y = 0) AS neg FROM pr GROUP BY 1, 2),
 c AS (SELECT target, p, round(sum(pos) OVER d / (sum(pos) OVER (PARTITION BY target))::DOUBLE - sum(neg) OVER d / (sum(neg) OVER (PARTITION BY target))::DOUBLE, 12) AS j FROM s WINDOW d AS (PARTITION BY target ORDER BY p DESC)),
 b AS (SELECT target, p, j FROM c QUALIFY row_number() OVER (PARTITION BY target ORDER BY j DESC, p DESC) = 1) SELECT target, CASE WHEN j > 0 THEN p ELSE 'inf'::DOUBLE END AS thr, round(greatest(j, 0.0::DOUBLE), 9) AS j FROM b""")
def youden(spark, sf_dir):
    return metrics.youden(_predictions(spark, sf_dir), ["target"]).withColumn("j", F.round("j", 9))


@query("WITH " + PRED + " SELECT target, round(avg(1.0::DOUBLE / (1.0::DOUBLE + exp(-p))), 9) AS mean FROM pr GROUP BY 1")
def mean_sigmoid(spark, sf_dir):
    p = _predictions(spark, sf_dir).withColumn("s", metrics.sigmoid(F.col("p")))
    return p.groupBy("target").agg(F.round(F.avg("s"), 9).alias("mean"))


# Features


FEATURES_SQL = "WITH " + GROUPS_SQL + """, ids AS (SELECT DISTINCT target, agg_id FROM grouped), n AS (SELECT max(epoch) + 1 AS n FROM traces), have AS (SELECT target, agg_id, roi * n + epoch AS idx, cnt FROM cnts, n),
 x AS (SELECT f.target, f.agg_id, f.idx, coalesce(cnt, 0)::DOUBLE AS x FROM (SELECT ids.target, ids.agg_id, c.idx FROM ids JOIN (SELECT DISTINCT target, idx FROM have) c USING (target)) f LEFT JOIN have USING (target, agg_id, idx)),
 s AS (SELECT target, agg_id, idx, x, avg(x) OVER w AS mean, stddev_pop(x) OVER w AS sd, min(x) OVER w AS lo, max(x) OVER w AS hi FROM x WINDOW w AS (PARTITION BY target, idx))
 SELECT target, agg_id, CAST(idx AS INT) AS idx, """


def _scaled(spark, sf_dir, kind):
    members = grouped(spark, sf_dir).select("target", "split", "agg_id", "label").distinct()
    rows = classify.features(counts(spark, sf_dir), members, grid_size(spark, sf_dir)[1])
    return classify.scaled(rows, kind).withColumn("z", F.round("z", 6) + 0.0)


@query(FEATURES_SQL + "round((x - mean) / CASE WHEN sd > 1e-12 THEN sd ELSE 1.0::DOUBLE END, 6) + 0.0 AS z FROM s")
def features_scaled(spark, sf_dir):
    """Each target's cells over its groups, standardised; zeros count."""
    return _scaled(spark, sf_dir, "Standard")


@query(FEATURES_SQL + "round((x - lo) / CASE WHEN hi > lo THEN hi - lo ELSE 1.0::DOUBLE END, 6) + 0.0 AS z FROM s")
def features_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "MinMax")


# Sources and sinks, by writing and reading again


@query("WITH " + POINTS_SQL + " SELECT CAST(user_id AS VARCHAR) AS user_id, ts, lon, lat FROM points")
def geojson_round_trip(spark, sf_dir):
    """Points as whole GeoJSON collections, one a task, with a line feature beside each that the reader leaves out."""
    geom = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geomPoint.geom")
    point = points(spark, sf_dir).select(F.to_json(F.struct(F.col("user_id").cast("string").alias("user"), F.col("ts").alias("timestamp"), geom)).alias("value"))
    path = new_path(spark)
    sinks.collections(point.withColumn("value", F.explode(F.array("value", F.replace("value", F.lit('"Point"'), F.lit('"LineString"'))))), path)
    return readers.geojson(spark, path)


@query("WITH " + POINTS_SQL + " SELECT CAST(user_id AS VARCHAR) AS user_id, ts, lon, lat FROM points")
def geojson_lines_round_trip(spark, sf_dir):
    """Points as one GeoJSON feature a line."""
    geom = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geomPoint.geom")
    path = new_path(spark)
    points(spark, sf_dir).select(F.to_json(F.struct(F.col("user_id").cast("string").alias("user"), F.col("ts").alias("timestamp"), geom))).write.text(path)
    return readers.geojson(spark, path, lines=True)


@query("WITH " + POINTS_SQL + " SELECT k AS site_id, k AS arr_id, round(avg(lon), 6) AS lon, round(avg(lat), 6) AS lat FROM points WHERE k <= 40 GROUP BY k")
def sites_round_trip(spark, sf_dir):
    path = new_path(spark)
    at = points(spark, sf_dir).groupBy("k").agg(F.round(F.avg("lon"), 6).alias("lon"), F.round(F.avg("lat"), 6).alias("lat"))
    at.select(F.col("k").alias("site_id"), F.col("k").alias("arr_id"), "lon", "lat").write.csv(path, header=True)
    return readers.sites(spark, path, 40)


@query("WITH " + GROUPS_SQL + " SELECT target, agg_id, label, roi, epoch, cnt FROM cnts WHERE target = (SELECT min(target) FROM targets)")
def bundle_round_trip(spark, sf_dir):
    """Aggregates written by split and target, and one target's read again, which reads its folder only."""
    path = new_path(spark)
    sinks.bundle(counts(spark, sf_dir).withColumn("split", F.lit("test")), path)
    first = targets(spark, sf_dir).agg(F.min("target")).first()[0]
    return readers.table(spark, path).where((F.col("split") == "test") & (F.col("target") == first)).select("target", "agg_id", "label", "roi", "epoch", "cnt")


# Procedural operators: rows only


@query()
def adjacency_edges(spark, sf_dir):
    """Neighbours among all places where there were events, to a hundred metres or so."""
    at = points(spark, sf_dir).select(F.round("lon", 3).alias("lon"), F.round("lat", 3).alias("lat")).distinct()
    return adjacency.neighbours(prep.dense_index(at, "lon", "lat", name="roi").select(F.col("roi").cast("int").alias("roi"), "lon", "lat"))


def _adjacent(spark, n_rois):
    """ROIs of a square grid, row by row, with their four neighbours."""
    width = max(1, math.isqrt(max(0, n_rois - 1)) + 1)
    ids = spark.range(n_rois).select(F.col("id").cast("int").alias("roi"))
    near = ids.withColumn("nbr", F.explode(F.array(F.col("roi") - width, F.col("roi") + width, F.when(F.col("roi") % width > 0, F.col("roi") - 1), F.when(F.col("roi") % width < width - 1, F.col("roi") + 1))))
    return near.where(f"nbr >= 0 and nbr < {n_rois}")


@query()
def synth_cluster(spark, sf_dir):
    """A cluster of 10 neighbouring places around the first visit of each user, places being those of the events."""
    first = visits(spark, sf_dir).groupBy("user_id").agg(F.min_by("roi", "event_id").alias("start"))
    return growth.clusters(first, _adjacent(spark, grid_size(spark, sf_dir)[0]), 10)


@query()
def synth_traces(spark, sf_dir):
    n_rois, n_epochs = grid_size(spark, sf_dir)
    c = keep(counts(spark, sf_dir).select("agg_id", "roi", "epoch", "cnt"))
    return synthesis.traces(audit.shares(c, "roi", n_rois, ["agg_id"], SMALL), audit.shares(c, "epoch", n_epochs, ["agg_id"], SMALL), _adjacent(spark, n_rois), ["agg_id"], 20, 12.0)


def _means(spark, sf_dir, **changed):
    n_rois, n_epochs = grid_size(spark, sf_dir)
    config, keys = replace(SMALL, **changed).coupled(), ["target", "agg_id"]
    c = keep(privacy.suppress(counts(spark, sf_dir), config.suppress))
    groups = grouped(spark, sf_dir).select(*keys).distinct()
    return audit.mean_visits(c, groups, keep(audit.shares(c, "roi", n_rois, keys, config)), keep(audit.shares(c, "epoch", n_epochs, keys, config)), _adjacent(spark, n_rois), keys, n_rois, n_epochs, config, rounds=2)


@query()
def mean_fixed_point(spark, sf_dir):
    return _means(spark, sf_dir, suppress=1)


@query("WITH " + GROUPS_SQL + f" SELECT target, agg_id, round(sum(cnt) / {M}::DOUBLE, 9) AS mean FROM cnts GROUP BY ALL")
def mean_of_raw_release(spark, sf_dir):
    return _means(spark, sf_dir).withColumn("mean", F.round("mean", 9))


class _Bundle:
    """A bundle for as many users as there are, its targets' traces, and what audits of it need to know."""

    def __init__(self, spark, sf_dir):
        v = keep(visits(spark, sf_dir).select("user_id", "roi", "epoch"))
        self.n_rois, self.n_epochs = (int(x or 0) for x in v.agg(F.max("roi") + 1, F.max("epoch") + 1).first())
        n_epochs = max(1, self.n_epochs)
        traces = keep(bitmaps.of_traces(v, n_epochs))  # visits are shuffled once, by their users
        sizes = keep(traces.groupBy("user_id").agg(F.sum("n").alias("n_visits")))
        n_users = sizes.count()
        self.build, self.audit = build_config(n_users), audit_config(n_users)
        groups, counted = build.bundle_of(traces, sizes, n_epochs, self.build)
        self.groups, self.counts = keep(groups), keep(counted)
        self.own = keep(build.target_cells(v, self.groups).distinct())
        self.population = sizes.groupBy("n_visits").agg(F.count("*").alias("n_users"))

    def reference(self, **changed):
        return audit.reference_prior(self.groups, self.counts, self.own, self.n_rois, self.n_epochs, replace(self.audit, **changed).coupled())

    def marginal(self, spark, **changed):
        config = replace(self.audit, mode="marginal_prior", **changed).coupled()
        return audit.marginal_prior(self.groups, self.counts, self.own, _adjacent(spark, self.n_rois), self.n_rois, self.n_epochs, config, self.population)


@query("WITH " + TRACES_SQL + f""", nu AS (SELECT count(*) AS n FROM sizes), tg AS (SELECT user_id AS target, row_number() OVER (ORDER BY {u(chr(39) + 'target' + chr(39), '42', 'user_id')}, user_id) AS r FROM sizes WHERE n_visits >= 10)
 SELECT target, split, label, n_aggregates FROM tg, nu, (VALUES ('train', 8::BIGINT), ('validation', 4::BIGINT), ('test', 4::BIGINT)) s(split, n_aggregates), (VALUES (0), (1)) l(label) WHERE r <= greatest({TARGETS}, least(50, n // 300))""")
def bundle_meta(spark, sf_dir):
    return readers.bundle_meta(_Bundle(spark, sf_dir).counts)


@query()
def audit_reference_prior(spark, sf_dir):
    return _Bundle(spark, sf_dir).reference()


@query()
def audit_reference_prior_noisy(spark, sf_dir):
    return metrics.scores(_Bundle(spark, sf_dir).reference(dp_eps=1.0, dp_sens=1, suppress=1, partial="random", partial_fraction=0.5, pca=0.9, scaler="MinMax"))


@query()
def audit_reference_prior_unpaired(spark, sf_dir):
    """Training groups of their own instead of pairs, half of the groups, and all but one of the targets."""
    b = _Bundle(spark, sf_dir)
    return b.reference(paired=False, train_size=8, validation_size=4, n_groups=4, n_targets=b.audit.n_targets - 1)


@query()
def audit_marginal_prior_reuse(spark, sf_dir):
    return _Bundle(spark, sf_dir).marginal(spark, reuse_synthetic=True)


@query()
def audit_marginal_prior(spark, sf_dir):
    return _Bundle(spark, sf_dir).marginal(spark)


@query()
def audit_marginal_prior_true_activity(spark, sf_dir):
    return _Bundle(spark, sf_dir).marginal(spark, reuse_synthetic=True, true_mean=True, activity="true")


@query()
def audit_sweep(spark, sf_dir):
    """The suppression sweep's first thresholds, scored by run."""
    b = _Bundle(spark, sf_dir)
    found = audit.sweep(sweep(b.audit, "suppression")[:3], b.groups, b.counts, b.own, b.n_rois, b.n_epochs)
    return metrics.accuracy(found, ["tag"])


# Labelled extension: a stream has no counterpart in the published tool


@query("WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS roi FROM events) SELECT epoch_us(day) // 1000000 AS day, roi, count(*) AS cnt FROM e GROUP BY ALL HAVING count(*) > 1")
def extension_windowed_release(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return streaming.windowed(e.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("roi", F.regexp_extract("props", "([0-9]+)", 1).cast("int")), "1 day", 1)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visits -> traces -> aggregates over sampled groups -> suppression."""
    return privacy.suppress(counts(spark, sf_dir), 1)
