"""The registered queries over the driver's tables, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from framequarry.functions import camera, voxel
from framequarry.operators import chunks, features, graph, integration, matching, raster, rigid, trajectory, verify, voxels
from framequarry.sources import sinks
from framequarry.streaming import online, tracker

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL twin."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def _frame(spark: SparkSession, sf_dir: str, label: int, i: str, v: str) -> DataFrame:
    """The embeddings of one label as the keypoints of one frame."""
    return table(spark, sf_dir, "embeddings").filter(F.col("label") == label).select(F.col("vec_id").alias(i), F.col("embedding").alias(v))


DISTANCES = """
WITH d AS (SELECT a.vec_id AS i, b.vec_id AS j, acos(greatest(-1.0, least(1.0, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))) AS dist
           FROM embeddings a, embeddings b WHERE a.label = 0 AND b.label = 1)
"""


@query(DISTANCES + """
, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rk, lead(dist) OVER (PARTITION BY i ORDER BY dist, j) AS second FROM d)
, c AS (SELECT *, row_number() OVER (PARTITION BY j ORDER BY dist, i) AS rk, lead(dist) OVER (PARTITION BY j ORDER BY dist, i) AS second FROM d)
SELECT r.i, r.j, round(r.dist, 9) AS dist FROM r JOIN c ON r.i = c.i AND r.j = c.j
WHERE r.rk = 1 AND c.rk = 1 AND r.dist < 1.5 AND (r.second IS NULL OR r.dist < 0.98 * r.second) AND (c.second IS NULL OR c.dist < 0.98 * c.second)
""")
def mutual_ratio_match(spark, sf_dir):
    """Keypoints of two frames that are each other's nearest under the ratio test."""
    found = matching.mutual_ratio_matches(_frame(spark, sf_dir, 0, "i", "vi"), _frame(spark, sf_dir, 1, "j", "vj"), 1.5, 0.98)
    return found.select("i", "j", F.round("dist", 9).alias("dist"))


@query(DISTANCES + "SELECT i, j, round(dist, 9) AS dist, rank FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM d) WHERE rank <= 5")
def topk_matches(spark, sf_dir):
    """The five nearest keypoints of the other frame."""
    found = matching.nearest_matches(_frame(spark, sf_dir, 0, "i", "vi"), _frame(spark, sf_dir, 1, "j", "vj"), 5)
    return found.select("i", "j", F.round("dist", 9).alias("dist"), "rank")


@query("""
SELECT CAST(floor(l_quantity / 8) AS INT) AS bx, CAST(floor(l_discount * 100 / 8) AS INT) AS by_,
       round(sum(l_extendedprice * l_tax) / sum(l_tax), 6) AS mean, round(sum(l_tax), 6) AS weight, count(*) AS samples
FROM lineitem GROUP BY 1, 2 HAVING sum(l_tax) > 0.001
""")
def voxel_mean(spark, sf_dir):
    """Weighted mean of prices in blocks of quantity and discount."""
    rows = table(spark, sf_dir, "lineitem", "l_quantity", "l_discount", "l_extendedprice", "l_tax")
    cells = rows.select(voxel.voxel_to_block(F.col("l_quantity")).alias("bx"), voxel.voxel_to_block(F.col("l_discount") * 100).alias("by_"), "l_extendedprice", "l_tax")
    fused = voxels.fuse(cells, ["bx", "by_"], F.col("l_extendedprice"), F.col("l_tax")).filter("weight > 0")
    return fused.select("bx", "by_", F.round("mean", 6).alias("mean"), F.round("weight", 6).alias("weight"), "samples")


@query("""
SELECT user_id, round(CASE WHEN n > 0 THEN s / n END, 6) AS mean, CAST(greatest(n, 0) AS DOUBLE) AS weight FROM (
  SELECT user_id, sum(CASE WHEN event_type = 'error' THEN -value ELSE value END) AS s, sum(CASE WHEN event_type = 'error' THEN -1 ELSE 1 END) AS n FROM events GROUP BY user_id)
""")
def retract_mean(spark, sf_dir):
    """Mean value of each user after the samples of errors are taken out again."""
    rows = table(spark, sf_dir, "events", "user_id", "event_type", "value")
    sign = F.when(F.col("event_type") == "error", -1).otherwise(1)
    return voxels.fuse(rows, ["user_id"], F.col("value"), F.lit(1), sign).select("user_id", F.round("mean", 6).alias("mean"), F.col("weight").cast("double").alias("weight"))


NUMBERED = "WITH n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events)"


def _numbered(spark, sf_dir, *columns):
    rows = table(spark, sf_dir, "events", "user_id", "ts", "event_id", *columns)
    return chunks.numbered(rows, ["user_id"], ["ts", "event_id"])


@query(NUMBERED + """
SELECT user_id, CAST(floor(idx / 10) AS BIGINT) AS chunk, arg_max(event_id, struct_pack(v := value, e := -event_id)) AS event_id, max(value) AS value FROM n GROUP BY 1, 2
""")
def chunk_top(spark, sf_dir):
    """The event of largest value in every chunk of ten."""
    rows = _numbered(spark, sf_dir, "value").withColumn("chunk", F.floor(F.col("idx") / 10).cast("long"))
    return graph.worst(rows, ["user_id", "chunk"], "value", ["event_id"])


@query(NUMBERED + """
, o AS (SELECT user_id, event_id, CAST(floor(idx / 10) AS BIGINT) AS chunk, CAST(idx % 10 AS INT) AS slot FROM n)
SELECT user_id, event_id, chunk, slot FROM o UNION ALL SELECT user_id, event_id, chunk - 1, 10 FROM o WHERE slot = 0 AND chunk > 0
""")
def overlap_chunks(spark, sf_dir):
    """Count windows of eleven events that slide by ten."""
    return chunks.overlapping_chunks(_numbered(spark, sf_dir), 10).select("user_id", "event_id", "chunk", "slot")


@query("""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
       CAST(xor(xor((l_orderkey * 73856093) & 4294967295, (l_partkey * 19349669) & 4294967295), (l_suppkey * 83492791) & 4294967295) % 800000 AS BIGINT) AS bucket
FROM lineitem
""")
def spatial_hash(spark, sf_dir):
    """Hash bucket of integer coordinates."""
    rows = table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    return rows.withColumn("bucket", voxel.spatial_hash(F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey"), 800000))


@query("""
SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM events
""")
def asof_prev(spark, sf_dir):
    """The newest earlier purchase of each event's user."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "event_type")
    found = chunks.last_before(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", F.col("event_id"))
    return found.select("event_id", "user_id", "previous")


VERSIONS = """
WITH o AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders WHERE o_orderstatus <> 'P'),
     n AS (SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS v FROM orders WHERE o_orderstatus <> 'O'),
     c AS (SELECT coalesce(o.o_orderkey, n.o_orderkey) AS o_orderkey, CASE WHEN o.v IS NULL THEN 'add' WHEN n.v IS NULL THEN 'remove' WHEN o.v <> n.v THEN 'move' END AS op, o.v AS old_value, n.v AS new_value
           FROM o FULL OUTER JOIN n ON o.o_orderkey = n.o_orderkey)
"""


def _versions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    cents = F.round(F.col("o_totalprice") * 100).cast("long")
    old = rows.filter("o_orderstatus <> 'P'").select("o_orderkey", cents.alias("v"))
    new = rows.filter("o_orderstatus <> 'O'").select("o_orderkey", (cents + F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)).alias("v"))
    return trajectory.changes(old, new, "o_orderkey", "v")


@query(VERSIONS + "SELECT * FROM c WHERE op IS NOT NULL")
def changelog(spark, sf_dir):
    """Additions, removals and moves between two versions of orders."""
    return _versions(spark, sf_dir)


@query(VERSIONS + "SELECT o_orderkey, -1 AS sign, old_value AS value FROM c WHERE op IS NOT NULL AND old_value IS NOT NULL UNION ALL SELECT o_orderkey, 1, new_value FROM c WHERE op IS NOT NULL AND new_value IS NOT NULL")
def signed_changes(spark, sf_dir):
    """The same change log as retractions and insertions."""
    return trajectory.signed(_versions(spark, sf_dir), "o_orderkey")


@query(VERSIONS + "SELECT o_orderkey, op, old_value, new_value, CASE op WHEN 'remove' THEN 0 WHEN 'add' THEN 1 ELSE 2 END AS priority FROM c WHERE op IS NOT NULL ORDER BY priority, o_orderkey LIMIT 10")
def next_corrections(spark, sf_dir):
    """The ten changes to apply next."""
    return trajectory.corrections(_versions(spark, sf_dir), "o_orderkey")


@query("""
WITH w AS (SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) WHERE rk = 1)
SELECT o.o_custkey, o.o_orderkey, c.c_nationkey FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.o_custkey = o.o_custkey AND w.o_orderkey = o.o_orderkey)
""")
def worst_pairs_removed(spark, sf_dir):
    """Orders with their customer, without each customer's largest order."""
    orders = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    bad = graph.worst(orders, ["o_custkey"], "o_totalprice", ["o_orderkey"])
    kept = graph.drop_pairs(orders, bad, ["o_custkey", "o_orderkey"])
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    return kept.join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_custkey", "o_orderkey", "c_nationkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000)")
def isolated_nodes(spark, sf_dir):
    """Customers without any large order."""
    large = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").filter("o_totalprice > 400000")
    return graph.isolated(table(spark, sf_dir, "customer", "c_custkey", "c_name"), large, "c_custkey", "o_custkey")


@query("""
WITH RECURSIVE e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
                     WHERE list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) > 0.45),
     s AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
     r(node, reached) AS (SELECT DISTINCT u, u FROM s UNION SELECT r.node, s.v FROM r JOIN s ON r.reached = s.u)
SELECT node, min(reached) AS root FROM r GROUP BY node
""")
def components(spark, sf_dir):
    """Components of similar keypoints within a frame."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("frame"), F.col("vec_id").alias("key"), F.col("embedding").alias("d"))
    return graph.components(matching.similar_links(rows, 0.45))


@query("SELECT event_id, user_id, CAST(sum(CAST(value AS DECIMAL(18, 4))) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS total FROM events")
def prefix_sum(spark, sf_dir):
    """Running sum of each user's values."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    out = chunks.prefix_sum(rows, ["user_id"], ["ts", "event_id"], F.col("value").cast("decimal(18,4)"))
    return out.select("event_id", "user_id", F.col("total").cast("double").alias("total"))


@query("SELECT held, count(*) AS buckets FROM (SELECT (l_orderkey * 31 + l_partkey) % 5000 AS bucket, count(*) AS held FROM lineitem GROUP BY 1) GROUP BY held")
def histogram(spark, sf_dir):
    """How many hash buckets hold n rows."""
    return voxels.occupancy_histogram(table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey"), (F.col("l_orderkey") * 31 + F.col("l_partkey")) % 5000)


_W = "(PARTITION BY user_id ORDER BY ts, event_id)"


@query(f"""
WITH n AS (SELECT event_id, value AS c, lag(value, 2) OVER w AS a2, lag(value, 1) OVER w AS a1, lead(value, 1) OVER w AS b1, lead(value, 2) OVER w AS b2 FROM events WINDOW w AS {_W}),
     g AS (SELECT event_id, c, unnest([a2, a1, c, b1, b2]) AS v, unnest([exp(-2.0), exp(-0.5), 1.0, exp(-0.5), exp(-2.0)]) AS g FROM n)
SELECT event_id, round(sum(g * v) / sum(g), 6) AS smooth FROM g WHERE v IS NOT NULL AND abs(v - c) < 50 GROUP BY event_id
""")
def gauss_smooth_1d(spark, sf_dir):
    """Edge-keeping Gaussian mean along each user's events."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return chunks.smooth(rows, ["user_id"], ["ts", "event_id"], "value", 1.0, 50.0).select("event_id", F.round("smooth", 6).alias("smooth"))


@query(f"SELECT event_id, round((lead(value) OVER {_W} - lag(value) OVER {_W}) / 2, 6) AS slope FROM events")
def sobel_1d(spark, sf_dir):
    """Central difference along each user's events."""
    rows = table(spark, sf_dir, "events", "event_id", "user_id", "ts", "value")
    return chunks.derivative(rows, ["user_id"], ["ts", "event_id"], "value").select("event_id", F.round("slope", 6).alias("slope"))


@query("SELECT p_partkey, p_size, p_retailprice FROM part WHERE p_size BETWEEN 10 AND 20 AND p_retailprice BETWEEN 920 AND 980 AND p_partkey BETWEEN 100 AND 1000000")
def box_filter(spark, sf_dir):
    """Parts inside an axis-aligned box."""
    return voxels.within_box(table(spark, sf_dir, "part", "p_partkey", "p_size", "p_retailprice"), {"p_size": (10, 20), "p_retailprice": (920, 980), "p_partkey": (100, 1000000)})


@query("""
WITH r AS (SELECT p_partkey, p_retailprice AS low, p_retailprice + 0.25 AS high FROM part)
SELECT o_orderkey, p_partkey FROM orders JOIN r ON o_totalprice / 100 BETWEEN low AND high
""")
def range_join(spark, sf_dir):
    """Orders whose price in hundreds lies in a part's price range."""
    points = table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").select("o_orderkey", (F.col("o_totalprice") / 100).alias("x"))
    ranges = table(spark, sf_dir, "part", "p_partkey", "p_retailprice").select("p_partkey", F.col("p_retailprice").alias("low"), (F.col("p_retailprice") + 0.25).alias("high"))
    return voxels.range_join(points, ranges, "x", "low", "high", 0.25).select("o_orderkey", "p_partkey")


@query("""
SELECT l_returnflag, count(*) AS n, round(avg(l_quantity), 6) AS mean_x, round(avg(l_discount), 6) AS mean_y,
       round(var_pop(l_quantity), 4) AS xx, round(covar_pop(l_quantity, l_discount), 6) AS xy, round(var_pop(l_discount), 6) AS yy FROM lineitem GROUP BY l_returnflag
""")
def moments(spark, sf_dir):
    """Mean and covariance of points per group."""
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_discount")
    x, y = F.col("l_quantity"), F.col("l_discount")
    return rows.groupBy("l_returnflag").agg(
        F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean_x"), F.round(F.avg(y), 6).alias("mean_y"),
        F.round(F.var_pop(x), 4).alias("xx"), F.round(F.covar_pop(x, y), 6).alias("xy"), F.round(F.var_pop(y), 6).alias("yy"),
    )


@query("SELECT o_orderkey, CAST(o_orderstatus = 'O' AS INT) AS open, o_totalprice FROM orders WHERE o_totalprice > 1000 ORDER BY open DESC, o_totalprice DESC, o_orderkey LIMIT 30")
def worklist_topn(spark, sf_dir):
    """The thirty orders to look at next: open ones first, then the largest."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus", "o_totalprice").withColumn("open", (F.col("o_orderstatus") == "O").cast("int"))
    return trajectory.work_list(rows, "open", "o_totalprice", "o_orderkey", 1000.0, 30).select("o_orderkey", "open", "o_totalprice")


@query("""
SELECT count(*) AS frames, count(CASE WHEN event_type <> 'error' THEN 1 END) AS valid_frames,
       count(CASE WHEN event_type <> 'error' THEN 1 END) >= round(0.5 * count(*)) AS valid FROM events
""")
def frame_validity(spark, sf_dir):
    """Run summary: a run is valid if at least half of its frames are."""
    rows = table(spark, sf_dir, "events", "event_type")
    good = F.count_if(F.col("event_type") != "error")
    return rows.agg(F.count("*").alias("frames"), good.alias("valid_frames"), (good >= F.round(0.5 * F.count("*"))).alias("valid"))


@query("""
SELECT user_id, n, round(CASE WHEN n < 800 THEN 0.0 ELSE 1 / least(ln(n), 9) END, 9) AS weight FROM (SELECT user_id, count(*) * 40 AS n FROM events GROUP BY user_id)
""")
def dense_weights(spark, sf_dir):
    """Weight of a pair's dense term from its number of matches."""
    rows = table(spark, sf_dir, "events", "user_id").groupBy("user_id").agg((F.count("*") * 40).alias("n"))
    return rows.select("user_id", "n", F.round(camera.dense_weight(F.col("n")), 9).alias("weight"))


@query("SELECT user_id, ts, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rk FROM events) WHERE rk = 1")
def latest_version(spark, sf_dir):
    """The newest event of each user."""
    rows = table(spark, sf_dir, "events", "user_id", "ts", "event_id", "value").withColumn("version", F.struct("ts", "event_id"))
    return trajectory.latest(rows, ["user_id"], "version").select("user_id", "ts", "event_id", "value")


@query("""
SELECT DISTINCT CAST(floor(round(l_extendedprice / 100) / 8) AS INT) AS bx, CAST(floor(round(l_quantity) / 8) AS INT) AS by_ FROM lineitem
""")
def allocated_blocks(spark, sf_dir):
    """The blocks that any sample falls into."""
    rows = table(spark, sf_dir, "lineitem", "l_extendedprice", "l_quantity")
    return rows.select(voxel.world_to_block(F.col("l_extendedprice"), 100.0).alias("bx"), voxel.world_to_block(F.col("l_quantity"), 1.0).alias("by_")).distinct()


@query("""
SELECT o_orderstatus, CAST(floor(o_totalprice / 50000) AS INT) AS bx, max(floor(o_totalprice / 100000)) AS most FROM orders GROUP BY 1, 2 HAVING max(floor(o_totalprice / 100000)) > 0
""")
def live_blocks(spark, sf_dir):
    """Blocks whose largest whole weight is above 0."""
    rows = table(spark, sf_dir, "orders", "o_orderstatus", "o_totalprice").select("o_orderstatus", F.floor(F.col("o_totalprice") / 50000).cast("int").alias("bx"), (F.col("o_totalprice") / 100000).alias("weight"))
    return voxels.live_blocks(rows, ["o_orderstatus", "bx"]).select("o_orderstatus", "bx", F.col("most").cast("double").alias("most"))


CAMERA = camera.Camera(525.0, 520.0, 319.5, 239.5, 640, 480, 0.1, 8.0)
DEPTH = "o_totalprice / 100000"
POINT = f"""
WITH d AS (SELECT o_orderkey, o_custkey % 640 AS u, o_orderkey % 480 AS v, {DEPTH} AS z FROM orders),
     p AS (SELECT *, (u - 319.5) / 525.0::DOUBLE * z AS x, (v - 239.5) / 520.0::DOUBLE * z AS y FROM d)
"""


def _points(spark, sf_dir):
    """Orders as pixels with depth, back-projected."""
    rows = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice")
    rows = rows.select("o_orderkey", (F.col("o_custkey") % 640).alias("u"), (F.col("o_orderkey") % 480).alias("v"), (F.col("o_totalprice") / 100000).alias("z"))
    return rows.withColumn("p", CAMERA.back_project(F.col("u"), F.col("v"), F.col("z")))


@query(POINT + "SELECT o_orderkey, x, y, z FROM p")
def back_projection(spark, sf_dir):
    """Camera-space points of pixels."""
    return _points(spark, sf_dir).select("o_orderkey", "p.x", "p.y", "p.z")


@query(POINT + """
, m AS (SELECT o_orderkey, x + 0.25 AS x, y - 0.1 AS y, z + 0.5 AS z FROM p)
SELECT o_orderkey, CAST(trunc(x * 525.0 / z + 319.5 + 0.5) AS INT) AS u, CAST(trunc(y * 520.0 / z + 239.5 + 0.5) AS INT) AS v FROM m
WHERE z > 0 AND (2 * (x * 525.0 / z + 319.5) / 639 - 1) * 0.95 BETWEEN -1 AND 1 AND (1 - 2 * (y * 520.0 / z + 239.5) / 479) * 0.95 BETWEEN -1 AND 1 AND (z - 0.1) / 7.9 * 0.95 BETWEEN 0 AND 1
""")
def frustum_pixels(spark, sf_dir):
    """Pixels of moved points that the camera still sees."""
    x, y, z = F.col("p.x") + 0.25, F.col("p.y") - 0.1, F.col("p.z") + 0.5
    u, v = CAMERA.pixel(x, y, z)
    return _points(spark, sf_dir).filter(CAMERA.in_frustum(x, y, z)).select("o_orderkey", u.alias("u"), v.alias("v"))


@query(POINT + """
, k AS (SELECT CAST(trunc((x + 0.25) * 525.0 / z + 319.5 + 0.5) AS INT) AS u, CAST(trunc(y * 520.0 / z + 239.5 + 0.5) AS INT) AS v, z FROM p WHERE z > 0)
SELECT CAST(0 AS BIGINT) AS frame, u, v, min(z) AS depth FROM k WHERE u BETWEEN 0 AND 639 AND v BETWEEN 0 AND 479 GROUP BY u, v
""")
def recalibrated_depth(spark, sf_dir):
    """Depth as another camera sees it: the nearest point of each pixel."""
    rows = _points(spark, sf_dir).select(F.lit(0).cast("long").alias("frame"), "p.x", "p.y", "p.z")
    return verify.recalibrated_depth(rows, CAMERA, [1, 0, 0, 0.25, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1])


TURN = [0.36, 0.48, -0.8, 1.5, -0.8, 0.6, 0.0, -2.0, 0.48, 0.64, 0.6, 0.75]


@query("SELECT l_returnflag, unnest(range(12)) AS cell, unnest([" + ", ".join(map(str, TURN)) + "]::DOUBLE[]) AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def rigid_fit(spark, sf_dir):
    """The rigid motion that points of each group went through, found again from the points."""
    rows = table(spark, sf_dir, "lineitem", "l_returnflag", "l_quantity", "l_discount", "l_tax")
    src = [F.col("l_quantity") / 10, F.col("l_discount") * 10, F.col("l_tax") * 10]
    cells = F.array(*[F.lit(float(x)) for x in [*TURN, 0, 0, 0, 1]])
    moved = rows.select("l_returnflag", *[c.alias(n) for c, n in zip(src, rigid.SOURCE)]).withColumn("t", camera.transform_point(cells, *[F.col(n) for n in rigid.SOURCE]))
    fitted = rigid.kabsch(moved.select("l_returnflag", *rigid.SOURCE, *[F.col(f"t.{a}").alias(n) for a, n in zip("xyz", rigid.TARGET)]), ["l_returnflag"])
    return fitted.select("l_returnflag", F.posexplode(F.slice("transform", 1, 12)).alias("cell", "value"), "n").select("l_returnflag", F.col("cell").cast("long").alias("cell"), F.round("value", 6).alias("value"), "n")


@query("""
WITH t AS (SELECT user_id, 0.5 * atan2(2 * covar_pop(x, y), var_pop(x) - var_pop(y)) AS a FROM (SELECT user_id, value AS x, CAST(event_id % 97 AS DOUBLE) AS y FROM events) GROUP BY user_id),
     r AS (SELECT e.user_id, cos(a) * value + sin(a) * (event_id % 97) AS p, cos(a) * (event_id % 97) - sin(a) * value AS q FROM events e JOIN t ON e.user_id = t.user_id)
SELECT user_id, round(CASE WHEN max(p) - min(p) < 1e-5 OR max(q) - min(q) < 1e-5 THEN 0 ELSE (max(p) - min(p)) * (max(q) - min(q)) END, 4) AS area FROM r GROUP BY user_id
""")
def oriented_area(spark, sf_dir):
    """Area of the box along the principal axes of each user's points."""
    rows = table(spark, sf_dir, "events", "user_id", "value", "event_id").select("user_id", F.col("value").alias("x"), (F.col("event_id") % 97).cast("double").alias("y"))
    return rigid.box_area(rows, ["user_id"], "x", "y").select("user_id", F.round("area", 4).alias("area"))


@query("""
SELECT user_id, list_reduce(list(CAST(floor(value) AS DOUBLE) ORDER BY event_id), lambda a, x: round(a * 0.8 + x * 0.2)) AS colour FROM events GROUP BY user_id
""")
def colour_fold(spark, sf_dir):
    """Colours blended in order of arrival."""
    rows = table(spark, sf_dir, "events", "user_id", "event_id", "value").withColumn("c", F.floor("value"))
    return voxels.blend_colours(rows, ["user_id"], "event_id", "c")


@query("""
SELECT count(CASE WHEN value > 50 THEN 1 END) AS detected, count(CASE WHEN value > 50 AND event_type = 'purchase' THEN 1 END) AS correct, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS possible,
       correct / nullif(detected, 0) AS precision, detected / nullif(possible, 0) AS recall FROM events
""")
def precision_recall(spark, sf_dir):
    """Precision and recall of detected events."""
    rows = table(spark, sf_dir, "events", "value", "event_type").select((F.col("value") > 50).alias("detected"), ((F.col("value") > 50) & (F.col("event_type") == "purchase")).alias("correct"), (F.col("event_type") == "purchase").alias("possible"))
    return verify.precision_recall(rows)


@query("""
SELECT round(sqrt(avg(pow(o_totalprice / 1000 - l.x, 2) + pow(o_custkey - l.y, 2))), 6) AS rmse, count(*) AS frames
FROM orders JOIN (SELECT l_orderkey, l_extendedprice / 100 AS x, l_partkey AS y FROM lineitem WHERE l_linenumber = 1) l ON o_orderkey = l_orderkey
""")
def trajectory_rmse(spark, sf_dir):
    """Error between two trajectories over their common frames."""
    a = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("idx"), (F.col("o_totalprice") / 1000).alias("x"), F.col("o_custkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    b = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.col("l_orderkey").alias("idx"), (F.col("l_extendedprice") / 100).alias("x"), F.col("l_partkey").cast("double").alias("y"), F.lit(0.0).alias("z"))
    return trajectory.trajectory_error(a, b).select(F.round("rmse", 6).alias("rmse"), "frames")


@query("""
SELECT event_type AS stage, round(avg(CASE WHEN user_id % 3 = 0 THEN value END), 6) AS f0, round(avg(CASE WHEN user_id % 3 = 1 THEN value END), 6) AS f1, round(avg(CASE WHEN user_id % 3 = 2 THEN value END), 6) AS f2 FROM events GROUP BY event_type
""")
def timing_table(spark, sf_dir):
    """Mean time of each stage, one column a frame."""
    means = table(spark, sf_dir, "events", "event_type", "user_id", "value").groupBy(F.col("event_type").alias("stage"), (F.col("user_id") % 3).alias("frame")).agg(F.avg("value").alias("ms"))
    wide = sinks.timing_table(means, [0, 1, 2])
    return wide.select("stage", *[F.round(F.col(str(i)), 6).alias(f"f{i}") for i in range(3)])


@query("""
WITH s AS (SELECT unnest(range((SELECT max(c_custkey) + 1 FROM customer))) AS idx) SELECT s.idx, c.c_name, c.c_acctbal FROM s LEFT JOIN customer c ON c.c_custkey = s.idx
""")
def dense_frames(spark, sf_dir):
    """Every frame number, with its frame where there is one."""
    rows = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_acctbal").withColumnRenamed("c_custkey", "idx")
    return features.dense_frames(rows, (rows.agg(F.max("idx")).first()[0] or 0) + 1)


@query("""
WITH f AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error'), a AS (SELECT user_id AS k, count(*) AS n FROM events WHERE event_type = 'error' AND value > 80 GROUP BY 1)
SELECT f.k AS key, coalesce(a.n, 0) + 1 AS attempt FROM f LEFT JOIN a ON f.k = a.k WHERE coalesce(a.n, 0) + 1 <= 3
""")
def retry_list(spark, sf_dir):
    """What is tried again, and for which time."""
    bad = table(spark, sf_dir, "events", "user_id", "event_type", "value").filter("event_type = 'error'").withColumnRenamed("user_id", "key")
    return online.retry(bad.select("key").distinct(), bad.filter("value > 80").select("key"), 3)


@query("""
SELECT i, j, count(*) AS n FROM (SELECT least(o_custkey % 50, o_orderkey % 50) AS i, greatest(o_custkey % 50, o_orderkey % 50) AS j FROM orders) WHERE i < j GROUP BY i, j HAVING count(*) > 10
""")
def overlapping_pairs(spark, sf_dir):
    """Pairs of frames with more than ten common pixels."""
    a, b = F.col("o_custkey") % 50, F.col("o_orderkey") % 50
    links = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").select(F.least(a, b).alias("i"), F.greatest(a, b).alias("j")).filter("i < j").withColumn("good", F.lit(True))
    return verify.overlapping_pairs(links.select("i", "j").distinct(), links).select("i", "j", F.col("hits").alias("n"))


@query("""
WITH px AS (SELECT l_linenumber AS frame, CAST(l_partkey % 64 AS INT) AS u, CAST(l_suppkey % 48 AS INT) AS v, 5e-1 + avg(l_quantity) / 25 AS depth FROM lineitem GROUP BY 1, 2, 3),
grid AS (SELECT x, y, z, x * 1e-1 AS wx, y * 1e-1 AS wy, z * 1e-1 AS wz FROM range(-40, 60) a(x), range(-40, 41) b(y), range(1, 40) c(z)),
s AS (SELECT frame, x, y, z, wz, CAST(trunc((wx - frame * 5e-2) * 6e1 / wz + 3.15e1 + 5e-1) AS INT) AS u, CAST(trunc(wy * 6e1 / wz + 2.35e1 + 5e-1) AS INT) AS v FROM grid, (SELECT DISTINCT frame FROM px))
SELECT CAST(x AS INT) AS vx, CAST(y AS INT) AS vy, CAST(z AS INT) AS vz, round(avg(depth - wz), 6) + 0e0 AS sdf, CAST(count(*) AS DOUBLE) AS weight
FROM s JOIN px USING (frame, u, v) WHERE depth < 2.4e0 AND abs(depth - wz) < depth * 2e-2 + 6e-2 GROUP BY 1, 2, 3
""")
def integrate_frames(spark, sf_dir):
    """Depth images, one a line number, fused into voxels; the SQL looks every voxel of the room up in every image."""
    rows = table(spark, sf_dir, "lineitem", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    pixels = rows.groupBy(F.col("l_linenumber").alias("frame"), (F.col("l_partkey") % 64).cast("int").alias("u"), (F.col("l_suppkey") % 48).cast("int").alias("v")).agg((0.5 + F.avg("l_quantity") / 25).alias("depth"))
    eye = [F.lit(float(i % 5 == 0)) for i in range(16)]
    poses = rows.select(F.col("l_linenumber").alias("frame")).distinct().withColumn("transform", F.array(*eye[:3], F.col("frame") * 0.05, *eye[4:]))
    samples = integration.depth_samples(pixels, poses, camera.Camera(60.0, 60.0, 31.5, 23.5, 64, 48), 0.1, far=2.4)
    at = [F.col(b) * voxel.BLOCK + o for b, o in zip(integration.BLOCK_KEYS, voxel.local_position(F.col("li")))]
    return integration.integrate(samples).select(*[a.cast("int").alias(n) for a, n in zip(at, ("vx", "vy", "vz"))], (F.round("sdf", 6) + 0.0).alias("sdf"), "weight")


GRID = "WITH g AS (SELECT CAST(l_quantity AS BIGINT) AS vx, CAST(l_linenumber AS BIGINT) AS vy, CAST(round(l_discount * 100) AS BIGINT) AS vz, min(l_extendedprice) AS sdf FROM lineitem GROUP BY 1, 2, 3)"


@query(GRID + """
, p AS (SELECT o_orderkey AS id, (o_orderkey % 490) / 1e1 AS x, 1 + (o_custkey % 60) / 1e1 AS y, (o_orderkey % 97) / 1e1 AS z FROM orders)
SELECT id, round(sum(sdf * CASE WHEN ox = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END * CASE WHEN oy = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END * CASE WHEN oz = 1 THEN z - floor(z) ELSE 1 - (z - floor(z)) END), 6) AS sdf
FROM p, range(2) a(ox), range(2) b(oy), range(2) c(oz) JOIN g ON g.vx = CAST(floor(x) AS BIGINT) + ox AND g.vy = CAST(floor(y) AS BIGINT) + oy AND g.vz = CAST(floor(z) AS BIGINT) + oz GROUP BY id HAVING count(*) = 8
""")
def trilinear_sample(spark, sf_dir):
    """A grid of lowest prices sampled between its points; no row where one of the eight is missing."""
    rows = table(spark, sf_dir, "lineitem", "l_quantity", "l_linenumber", "l_discount", "l_extendedprice")
    grid = rows.groupBy(F.col("l_quantity").cast("long").alias("vx"), F.col("l_linenumber").cast("long").alias("vy"), F.round(F.col("l_discount") * 100).cast("long").alias("vz")).agg(F.min("l_extendedprice").alias("sdf"), F.count("*").alias("weight"))
    points = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select(F.col("o_orderkey").alias("id"), ((F.col("o_orderkey") % 490) / 10.0).alias("x"), (1 + (F.col("o_custkey") % 60) / 10.0).alias("y"), ((F.col("o_orderkey") % 97) / 10.0).alias("z"))
    return integration.trilinear(points, grid, 1.0).select("id", F.round("sdf", 6).alias("sdf"))


@query("""
WITH d AS (SELECT CAST(a.label AS BIGINT) AS i, CAST(b.label AS BIGINT) AS j, a.vec_id AS ki, b.vec_id AS kj, acos(greatest(-1.0, least(1.0, list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])))) AS dist
           FROM embeddings a JOIN embeddings b ON a.label < b.label)
, r AS (SELECT *, row_number() OVER (PARTITION BY i, j, ki ORDER BY dist, kj) AS rk, lead(dist) OVER (PARTITION BY i, j, ki ORDER BY dist, kj) AS second FROM d)
, c AS (SELECT *, row_number() OVER (PARTITION BY i, j, kj ORDER BY dist, ki) AS rk, lead(dist) OVER (PARTITION BY i, j, kj ORDER BY dist, ki) AS second FROM d)
SELECT r.i, r.j, r.ki AS key_i, r.kj AS key_j, round(r.dist, 8) AS dist FROM r JOIN c ON r.i = c.i AND r.j = c.j AND r.ki = c.ki AND r.kj = c.kj
WHERE r.rk = 1 AND c.rk = 1 AND r.dist < 1.5 AND (r.second IS NULL OR r.dist < 0.98 * r.second) AND (c.second IS NULL OR c.dist < 0.98 * c.second)
""")
def match_frames(spark, sf_dir):
    """Every frame's keypoints against those of all earlier frames."""
    points = table(spark, sf_dir, "embeddings").select(F.col("label").alias("frame"), F.col("vec_id").alias("key"), F.col("embedding").alias("descriptor"))
    found = matching.match_frames(points, matching.earlier_pairs(points.select("frame")), 1.5, 0.98)
    return found.withColumn("dist", F.round("dist", 8))


@query("""
SELECT user_id AS frame, level, CAST(floor((event_id % 64) / pow(2, level)) AS BIGINT) AS u, CAST(floor((event_id // 64 % 48) / pow(2, level)) AS BIGINT) AS v, count(*) AS n
FROM events, (SELECT unnest([1, 2, 3]) AS level) GROUP BY 1, 2, 3, 4
""")
def presence_pyramid(spark, sf_dir):
    """How many of a frame's pixels lie in cells of three sizes."""
    return raster.presence(_event_pixels(spark, sf_dir), ["frame"], 3)


def _event_pixels(spark, sf_dir):
    """Each user's events as pixels of 64 x 48."""
    at = F.floor(F.col("event_id") / 64)
    return table(spark, sf_dir, "events", "user_id", "event_id", "value").select(F.col("user_id").alias("frame"), (F.col("event_id") % 64).alias("u"), (at % 48).alias("v"), "value")


@query("""
SELECT user_id AS frame, CAST(floor((event_id % 64) / 2) AS BIGINT) AS u, CAST(floor((event_id // 64 % 48) / 2) AS BIGINT) AS v,
       count(*) FILTER (value > 50) > 0 AS some, count(DISTINCT CASE WHEN value > 50 THEN (event_id % 64) % 2 * 2 + (event_id // 64 % 48) % 2 END) = 4 AS every FROM events GROUP BY 1, 2, 3
""")
def patch_flags(spark, sf_dir):
    """Whether some, and whether all, pixels of each patch are set."""
    return raster.patches(_event_pixels(spark, sf_dir), ["frame"], F.col("value") > 50)


@query("""
WITH f AS (SELECT CAST(user_id AS VARCHAR) AS session, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS idx, CASE WHEN event_id % 5 <> 0 THEN floor(value) END AS local FROM events WHERE user_id IS NOT NULL),
c AS (SELECT *, greatest(idx - 1, 0) // 10 AS chunk FROM f),
v AS (SELECT session, idx, CASE WHEN row_number() OVER w = 1 THEN 0 WHEN lag(chunk) OVER w = chunk THEN local - lag(local) OVER w ELSE local END AS step FROM c WHERE local IS NOT NULL WINDOW w AS (PARTITION BY session ORDER BY idx)),
x AS (SELECT session, idx, sum(step) OVER (PARTITION BY session ORDER BY idx) AS x FROM v)
SELECT c.session, c.idx, CAST(c.chunk AS BIGINT) AS chunk, x.x, c.local IS NOT NULL AS valid FROM c LEFT JOIN x USING (session, idx)
""")
def tracked_positions(spark, sf_dir):
    """Each user's events as frames with positions in their chunks, as one running track; every fifth event is no frame."""
    order = W.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events", "user_id", "event_id", "value").filter("user_id is not null").withColumn("idx", (F.row_number().over(order) - 1).cast("long"))
    cells = [F.floor("value").cast("double") if k == 3 else F.lit(1.0 if k % 5 == 0 else 0.0) for k in range(16)]
    frames = rows.select(F.col("user_id").cast("string").alias("session"), "idx", F.when((F.col("event_id") % 5 != 0) & F.col("value").isNotNull(), F.array(*cells)).alias("local"))
    return tracker.track_batch(frames, 10, 0).select("session", "idx", "chunk", F.col("pose")[3].alias("x"), "valid")


LINKS = "WITH l AS (SELECT o_custkey % 50 AS i, o_orderkey % 50 AS j, o_totalprice, o_orderstatus FROM orders)"


def _order_links(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus").select((F.col("o_custkey") % 50).alias("i"), (F.col("o_orderkey") % 50).alias("j"), "o_totalprice", "o_orderstatus")


@query(LINKS + """
, p AS (SELECT i, j FROM l GROUP BY i, j HAVING max(o_totalprice) > 200000), m AS (SELECT i, j, max(o_totalprice / 1e6) AS worst FROM l WHERE o_orderstatus = 'F' GROUP BY i, j)
SELECT p.j, count(*) AS total, count(m.worst) AS detected, count(CASE WHEN m.worst < 3e-1 THEN 1 END) AS correct FROM p LEFT JOIN m ON p.i = m.i AND p.j = m.j GROUP BY p.j
""")
def evaluation_counts(spark, sf_dir):
    """Pairs that overlap, are matched, and are matched rightly, for each frame."""
    links = _order_links(spark, sf_dir)
    pairs = links.groupBy("i", "j").agg((F.max("o_totalprice") > 200000).alias("overlaps"))
    return verify.evaluation_counts(pairs, links.filter("o_orderstatus = 'F'").select("i", "j", (F.col("o_totalprice") / 1e6).alias("error2")), 0.3)


@query(LINKS + " SELECT i, j, count(*) AS n, round(count(*) / max(count(*)) OVER (), 9) AS share FROM l GROUP BY i, j")
def pair_counts(spark, sf_dir):
    """Links of each pair of frames, also as a share of the most."""
    return verify.pair_counts(_order_links(spark, sf_dir)).withColumn("share", F.round("share", 9))


@query(LINKS + ", b AS (SELECT i AS node, j AS other FROM l WHERE i <> j UNION SELECT j, i FROM l WHERE i <> j) SELECT node, count(*) AS n, min(other) AS first, max(other) AS last FROM b GROUP BY node")
def linked_neighbours(spark, sf_dir):
    """How many different frames each frame is linked with, the first and the last."""
    return verify.neighbours(_order_links(spark, sf_dir)).select("node", F.size("others").cast("long").alias("n"), F.col("others")[0].alias("first"), F.element_at("others", -1).alias("last"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
