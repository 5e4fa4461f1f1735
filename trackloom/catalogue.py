"""All queries over the operators on tracks, by name, with the same in DuckDB's SQL where SQL can express it.

Tracks are derived from the test tables by rule (``sources.adapters``): long ones from events, short ones from lineitem. Floating results
are rounded to six places on both sides, as sums may be taken in any order.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import quantiles, scalar
from .operators import charts, classify, cleaning, clusters, features, optics, stats
from .operators import trajectories as tr
from .plans.settings import CLASS_MAP
from .sources import adapters, frames, legacy_json

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
FPS = 30.0
NAMES = {v: k for k, v in CLASS_MAP.items()}
COLOURS = {0: (255, 0, 0), 2: (0, 255, 0), 5: (0, 0, 255)}
#: Parameters of density clustering that tuning tries.
GRID = {"min_samples": [10, 20, 30], "xis": [0.01, 0.03, 0.05], "max_eps": [0.1, 0.15, 0.2]}


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c, 6) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(name: str, sql: str | None = None, doubles: str = "") -> Callable:
    """Registers a query; ``doubles`` names the result's floating columns, which the SQL rounds."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            changed = ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in doubles.split())
            ORACLE[name] = f"SELECT * REPLACE ({changed}) FROM ({sql})" if changed else sql
        return f

    return add


def _h() -> str:
    rows = tr.smoothing_rows(9, 2)
    return "[" + ", ".join("[" + ", ".join(f"{v!r}::DOUBLE" for v in map(float, r)) + "]" for r in rows) + "]"


def _gradient(s: str) -> str:
    return f"list_transform(range(n), lambda p: (CASE WHEN n = 1 THEN NULL WHEN p = 0 THEN {s}[2] - {s}[1] WHEN p = n - 1 THEN {s}[n] - {s}[n - 1] ELSE ({s}[p + 2] - {s}[p]) / 2 END) * {FPS})"


def _smooth(v: str) -> str:
    first = "greatest(0, least(p - 4, n - 9))"
    return f"list_transform(range(n), lambda p: CASE WHEN n < 9 THEN {v}[p + 1] ELSE list_sum(list_transform(range(9), lambda k: h[p - {first} + 1][k + 1] * {v}[{first} + k + 1])) END)"


TRAJ = f"""
seq AS (SELECT track_id, list(frame ORDER BY frame) AS fr, list(cx ORDER BY frame) AS xs, list(cy ORDER BY frame) AS ys, count(*) AS n, {_h()} AS h FROM tracks GROUP BY track_id),
smooth AS (SELECT track_id, fr, n, {_smooth('xs')} AS x, {_smooth('ys')} AS y FROM seq),
moving AS (SELECT *, {_gradient('x')} AS vx, {_gradient('y')} AS vy FROM smooth),
pushed AS (SELECT *, {_gradient('vx')} AS ax, {_gradient('vy')} AS ay FROM moving),
traj AS (SELECT track_id, unnest(fr) AS frame, unnest(x) AS x, unnest(y) AS y, unnest(vx) AS vx, unnest(vy) AS vy, unnest(ax) AS ax, unnest(ay) AS ay FROM pushed),
speeds AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed, sqrt(ax * ax + ay * ay) AS accel FROM traj)"""
ENDS = """ends AS (SELECT track_id, arg_min(cx, frame) AS x_entry, arg_min(cy, frame) AS y_entry, arg_max(cx, frame) AS x_exit, arg_max(cy, frame) AS y_exit FROM tracks GROUP BY track_id)"""
OUT = """noisy AS (SELECT * FROM labels JOIN ends USING (track_id) WHERE cluster = -1),
outliers AS (SELECT track_id, x_entry, y_entry, x_exit, y_exit, CASE WHEN isinf(reachability) THEN 2 * (SELECT coalesce(max(reachability) FILTER (NOT isinf(reachability)), 1.0) FROM noisy) ELSE reachability END AS reachability, isinf(reachability) AS is_unreachable FROM noisy)"""
CLUSTERED = "clustered AS (SELECT labels.track_id, cluster, x_entry, y_entry, x_exit, y_exit FROM labels JOIN ends USING (track_id) WHERE cluster >= 0)"
METRICS = """metrics AS (SELECT *, x_max - x_min AS x_range, y_max - y_min AS y_range, sqrt((x_max - x_min) * (x_max - x_min) + (y_max - y_min) * (y_max - y_min)) AS travel_distance FROM (
  SELECT track_id, count(frame) AS duration, max(speed) AS speed_max, max(accel) AS accel_max, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM speeds GROUP BY track_id)),
flags AS (SELECT *, is_too_short OR is_too_fast OR is_too_jerky OR is_stationary AS is_noise FROM (
  SELECT *, coalesce(duration < 10, false) AS is_too_short, coalesce(speed_max > (SELECT quantile_cont(speed, 0.99) FROM speeds), false) AS is_too_fast,
         coalesce(accel_max > (SELECT quantile_cont(accel, 0.99) FROM speeds), false) AS is_too_jerky, coalesce(travel_distance < 0.05, false) AS is_stationary FROM metrics))"""


def long_(body: str, *parts: str) -> str:
    return f"WITH {', '.join((adapters.DUCK_LONG, *parts))} {body}"


def short(body: str, *parts: str) -> str:
    return f"WITH {', '.join((adapters.DUCK_SHORT, *parts))} {body}"


LAB = (adapters.DUCK_LABELS, ENDS)


def A(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return adapters.long_tracks(spark, d)


def B(spark: SparkSession, d: str) -> DataFrame:  # noqa: N802
    return adapters.short_tracks(spark, d)


def moving(spark: SparkSession, d: str, of: Callable = A) -> DataFrame:
    return tr.build_trajectories(of(spark, d), FPS)


def speeds(spark: SparkSession, d: str, of: Callable = A) -> DataFrame:
    return tr.with_speed(moving(spark, d, of))


def ends(spark: SparkSession, d: str) -> DataFrame:
    return tr.entry_exit(A(spark, d), "cx", "cy")


def labels(spark: SparkSession, d: str) -> DataFrame:
    return adapters.labels(spark, A(spark, d))


def outliers(spark: SparkSession, d: str) -> DataFrame:
    return clusters.outlier_table(ends(spark, d), labels(spark, d).withColumn("index", F.lit(0).cast("bigint"))).drop("index")


def clustered(spark: SparkSession, d: str) -> DataFrame:
    return clusters.clustered_ends(labels(spark, d).select("track_id", "cluster"), ends(spark, d))


def flags(spark: SparkSession, d: str, of: Callable = B) -> DataFrame:
    return cleaning.flagged_tracks(speeds(spark, d, of))


# Sources ------------------------------------------------------------------------------------------------------------------------------

DETECTION_COLUMNS = "frame, track_id, cls, conf, cx, cy, w, h"


@query("p08_detections_long", long_(f"SELECT {DETECTION_COLUMNS} FROM tracks"), "conf cx cy w h")
def _(spark, d):
    return A(spark, d).select(*DETECTION_COLUMNS.split(", "))


@query("p08_detections_short", short(f"SELECT {DETECTION_COLUMNS} FROM tracks"), "conf cx cy w h")
def _(spark, d):
    return B(spark, d).select(*DETECTION_COLUMNS.split(", "))


@query("s06_s07_legacy_json", long_(f"SELECT {DETECTION_COLUMNS} FROM tracks"), "conf cx cy w h")
def _(spark, d):
    return legacy_json.rows_of(legacy_json.entities(legacy_json.to_entities(A(spark, d), NAMES)), CLASS_MAP)


HISTORY = """SELECT CAST(k - 1 AS BIGINT) AS frame, track_id, CAST(-1 AS BIGINT) AS cls, 0.0::DOUBLE AS conf, xs[k] AS cx, ys[k] AS cy, 0.0::DOUBLE AS w, 0.0::DOUBLE AS h
FROM (SELECT track_id, list(cx ORDER BY frame) AS xs, list(cy ORDER BY frame) AS ys, unnest(range(1, count(*) + 1)) AS k FROM tracks GROUP BY track_id)"""


@query("s07_history_fallback", long_(HISTORY), "conf cx cy w h")
def _(spark, d):
    per = A(spark, d).groupBy(F.col("track_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("frame", "cx", "cy"))).alias("p"))
    text = per.select(F.to_json(F.struct("id", F.col("p.cx").alias("history_X"), F.col("p.cy").alias("history_Y"))).alias("value"))
    return legacy_json.rows_of(legacy_json.entities(text))


RESULTS = "SELECT event_type AS video, event_id AS frame_no, cx - w / 2 AS x1, cy - h / 2 AS y1, cx + w / 2 AS x2, cy + h / 2 AS y2, conf, CASE WHEN track_id % 3 = 0 THEN NULL ELSE cls END AS cls, CASE WHEN track_id % 4 = 0 THEN NULL ELSE track_id END AS id, track_id % 5 = 0 AS empty FROM raw"
RAW = "raw AS (SELECT event_type, event_id, user_id AS track_id, CAST(user_id % 9 AS BIGINT) AS cls, CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS conf, value / 1000 AS cx, CAST(event_id % 1000 AS DOUBLE) / 1000 AS cy, 0.02::DOUBLE AS w, 0.04::DOUBLE AS h FROM events)"
FRAMES = f"""WITH {RAW}, results AS ({RESULTS}), numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY video ORDER BY frame_no) - 1 AS BIGINT) AS frame FROM results)
SELECT video, frame, coalesce(id, -1) AS track_id, coalesce(cls, -1) AS cls, coalesce(conf, 0.0) AS conf, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy, x2 - x1 AS w, y2 - y1 AS h FROM numbered WHERE NOT empty"""


def results(spark: SparkSession, d: str) -> DataFrame:
    raw = spark.read.parquet(f"{d}/events.parquet").selectExpr(
        "event_type", "event_id", "user_id AS track_id", "CAST(user_id % 9 AS BIGINT) AS cls", "CASE WHEN event_id % 10 = 0 THEN NULL ELSE CAST(event_id % 100 AS DOUBLE) / 100 END AS conf",
        "value / 1000 AS cx", "CAST(event_id % 1000 AS DOUBLE) / 1000 AS cy", "0.02D AS w", "0.04D AS h",
    )
    flat = raw.selectExpr(
        "event_type AS video", "event_id AS frame_no", "named_struct('x1', cx - w / 2, 'y1', cy - h / 2, 'x2', cx + w / 2, 'y2', cy + h / 2, 'cls', CASE WHEN track_id % 3 = 0 THEN NULL ELSE cls END, 'conf', conf, 'id', CASE WHEN track_id % 4 = 0 THEN NULL ELSE track_id END) AS b", "track_id % 5 = 0 AS empty",
    )
    return flat.selectExpr("video", "frame_no", "CASE WHEN empty THEN array() ELSE array(b) END AS boxes")


@query("s03_p01_p02_p03_f13_frames", FRAMES, "conf cx cy w h")
def _(spark, d):
    return frames.detections(results(spark, d))


@query("f14_confidence_and_class", f"SELECT * FROM ({FRAMES}) WHERE conf >= 0.3 AND cls IN (2, 5)", "conf cx cy w h")
def _(spark, d):
    return frames.detections(results(spark, d), 0.3, [2, 5])


@query("s20_s21_report", long_("SELECT count(*) AS n_rows, count(DISTINCT track_id) AS n_tracks, min(frame) AS first_frame, max(frame) AS last_frame FROM tracks"))
def _(spark, d):
    return A(spark, d).agg(F.count("*").alias("n_rows"), F.count_distinct("track_id").alias("n_tracks"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))


# Scalar functions -----------------------------------------------------------------------------------------------------------------------

LABEL_CASES = "CASE event_id % 6 WHEN 0 THEN 'car' WHEN 1 THEN '7' WHEN 2 THEN 'dog' WHEN 3 THEN ' 12 ' WHEN 4 THEN 'bus' ELSE '' END"


@query("p04_j08_label_class", f"SELECT event_id, CAST(CASE label WHEN 'car' THEN 2 WHEN '7' THEN 7 WHEN ' 12 ' THEN 12 WHEN 'bus' THEN 5 ELSE -1 END AS BIGINT) AS cls FROM (SELECT event_id, {LABEL_CASES} AS label FROM events)")
def _(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{LABEL_CASES} AS label").select("event_id", scalar.class_lookup(F.col("label"), CLASS_MAP).alias("cls"))


NUMBER_CASES = "CASE event_id % 5 WHEN 0 THEN '0.25' WHEN 1 THEN '' WHEN 2 THEN 'abc' WHEN 3 THEN NULL ELSE '1e2' END"
FRAME_CASES = "CASE event_id % 7 WHEN 0 THEN '2.5' WHEN 1 THEN '3.5' WHEN 2 THEN '' WHEN 3 THEN NULL WHEN 4 THEN 'x' WHEN 5 THEN '9.0' ELSE '-1.5' END"


@query("p05_p06_p07_coercions", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.25::DOUBLE WHEN 4 THEN 100 ELSE 0 END AS value, CAST(CASE event_id % 7 WHEN 0 THEN 2 WHEN 1 THEN 4 WHEN 5 THEN 9 WHEN 6 THEN -2 ELSE 0 END AS BIGINT) AS frame FROM events", "value")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").selectExpr("event_id", f"{NUMBER_CASES} AS a", f"{FRAME_CASES} AS b")
    return rows.select("event_id", scalar.number(F.col("a")).alias("value"), scalar.frame_number(F.col("b")).alias("frame"))


@query("p09_p10_speed_accel", long_("SELECT track_id, frame, speed, accel FROM speeds", TRAJ), "speed accel")
def _(spark, d):
    return charts.speeds(moving(spark, d))


@query("p14_j06_min_max", long_("SELECT track_id, frame, (x - x0) / (x1 - x0) AS x_norm, (y - y0) / (y1 - y0) AS y_norm FROM traj, (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM traj)", TRAJ), "x_norm y_norm")
def _(spark, d):
    return cleaning.min_max(moving(spark, d)).select("track_id", "frame", "x_norm", "y_norm")


STANDARD = ", ".join(f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER () + 1e-10 * CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END) AS {c}" for c in clusters.ENDS)


@query("p15_m12_standardised", long_(f"SELECT track_id, {STANDARD} FROM ends", ENDS), " ".join(clusters.ENDS))
def _(spark, d):
    return cleaning.standardised(ends(spark, d), list(clusters.ENDS))


@query("s12_normalisation", long_("SELECT min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max FROM traj", TRAJ), "x_min x_max y_min y_max")
def _(spark, d):
    return cleaning.normalisation(moving(spark, d))


@query("p23_w05_velocity_arrows", long_("SELECT track_id, frame, vx / 30 AS dx, vy / 30 AS dy FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY frame) - 1 AS p, count(*) OVER (PARTITION BY track_id) AS n FROM traj) WHERE p % greatest(1, n // 10) = 0", TRAJ), "dx dy")
def _(spark, d):
    return tr.every_tenth(moving(spark, d)).select("track_id", "frame", (F.col("vx") / 30).alias("dx"), (F.col("vy") / 30).alias("dy"))


@query("p24_min_samples", long_("SELECT count(DISTINCT track_id) AS n, CAST(greatest(10, trunc(0.02 * count(DISTINCT track_id))) AS INTEGER) AS min_samples FROM tracks"))
def _(spark, d):
    return A(spark, d).agg(F.count_distinct("track_id").alias("n")).select("n", scalar.recommended_min_samples(F.col("n")).alias("min_samples"))


@query("p19_p20_p25_columns", long_("SELECT track_id, CAST(cx AS FLOAT) AS cx, CAST(cy AS FLOAT) AS cy FROM tracks"))
def _(spark, d):
    return scalar.float_features(scalar.kept_if_present(A(spark, d), ["track_id", "cx", "cy", "vx"]), ["cx", "cy"])


@query("p26_p27_p28_annotations", long_("""SELECT track_id, frame, CASE cls WHEN 0 THEN 'person' WHEN 1 THEN 'bicycle' WHEN 2 THEN 'car' WHEN 5 THEN 'bus' WHEN 7 THEN 'truck' ELSE CAST(cls AS VARCHAR) END || ' ' || printf('%.2f', conf) || CASE WHEN track_id >= 0 THEN ' ID:' || track_id ELSE '' END AS text,
CAST(trunc(cx * 1920) AS INTEGER) AS px, CAST(trunc(cy * 1080) AS INTEGER) AS py, CASE cls WHEN 0 THEN 255 WHEN 2 THEN 0 WHEN 5 THEN 0 ELSE 200 END AS red FROM tracks"""))
def _(spark, d):
    cls = F.col("cls").cast("int")
    return A(spark, d).select("track_id", "frame", scalar.annotation(cls, F.col("conf"), F.col("track_id"), NAMES).alias("text"), scalar.pixel(F.col("cx") * 1920).alias("px"), scalar.pixel(F.col("cy") * 1080).alias("py"), F.get(scalar.colour(cls, COLOURS), F.lit(0)).alias("red"))


# Windows and entry/exit -------------------------------------------------------------------------------------------------------------------

TRAJ_COLUMNS = "x y vx vy ax ay"


@query("w01_w02_w03_trajectories", long_("SELECT * FROM traj", TRAJ), TRAJ_COLUMNS)
def _(spark, d):
    return moving(spark, d)


@query("w01_w02_w03_short_tracks", short("SELECT * FROM traj", TRAJ), TRAJ_COLUMNS)
def _(spark, d):
    return moving(spark, d, B)


@query("a07_t01_j07_entry_exit", long_("SELECT * FROM ends", ENDS), " ".join(clusters.ENDS))
def _(spark, d):
    return ends(spark, d)


QUERIES["entry_exit"] = QUERIES["a07_t01_j07_entry_exit"]
ORACLE["entry_exit"] = ORACLE["a07_t01_j07_entry_exit"]


@query("a07_entry_exit_by_position", short("SELECT * FROM ends", ENDS), " ".join(clusters.ENDS))
def _(spark, d):
    return tr.entry_exit(B(spark, d), "cx", "cy", skip_nulls=False)


@query("a08_nested_and_back", long_("SELECT track_id, frame, cx, cy FROM tracks"), "cx cy")
def _(spark, d):
    return tr.unnested(tr.nested(A(spark, d).select("track_id", "frame", "cx", "cy")))


@query("w06_t11_empirical_cdf", short("SELECT CAST(n AS DOUBLE) AS value, CAST(row_number() OVER (ORDER BY n) AS DOUBLE) / count(*) OVER () AS fraction FROM (SELECT count(*) AS n FROM tracks GROUP BY track_id)"), "value fraction")
def _(spark, d):
    return stats.empirical_cdf(B(spark, d).groupBy("track_id").agg(F.count("*").cast("double").alias("duration")), "duration")


@query("w07_w09_ordinals", long_("SELECT track_id, CAST(row_number() OVER (ORDER BY track_id) - 1 AS BIGINT) AS index FROM (SELECT DISTINCT track_id FROM tracks)"))
def _(spark, d):
    return tr.ordinals(A(spark, d).select("track_id").distinct())


# Aggregates -------------------------------------------------------------------------------------------------------------------------------

STATS = "SELECT track_id, count(frame) AS frame_count, min(frame) AS frame_min, max(frame) AS frame_max, " + ", ".join(
    f"min({c}) AS {c}_min, max({c}) AS {c}_max, avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in "xy"
) + ", " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in ("vx", "vy", "ax", "ay")) + ", count(frame) AS duration FROM traj GROUP BY track_id"
STAT_COLUMNS = " ".join(f"{c}_{s}" for c in "xy" for s in ("min", "max", "mean", "std")) + " " + " ".join(f"{c}_{s}" for c in ("vx", "vy", "ax", "ay") for s in ("mean", "std"))


@query("a02_p12_p13_track_stats", long_(STATS, TRAJ), STAT_COLUMNS)
def _(spark, d):
    return stats.track_stats(moving(spark, d))


@query("a02_track_stats_short", short(STATS, TRAJ), STAT_COLUMNS)
def _(spark, d):
    return stats.track_stats(moving(spark, d, B))


METRIC_COLUMNS = "speed_max accel_max x_min x_max y_min y_max x_range y_range travel_distance"


@query("a03_p11_track_metrics", short("SELECT * FROM metrics", TRAJ, METRICS), METRIC_COLUMNS)
def _(spark, d):
    return cleaning.track_metrics(speeds(spark, d, B))


@query("a01_group_sizes", long_("SELECT track_id, count(*) AS size FROM tracks GROUP BY track_id"))
def _(spark, d):
    return A(spark, d).groupBy("track_id").agg(F.count("*").alias("size"))


@query("a04_a05_a17_describe", long_("SELECT count(speed) AS n, count(DISTINCT round(speed, 3)) AS n_distinct, min(round(speed, 3)) AS low, max(round(speed, 3)) AS high, avg(round(speed, 3)) AS mean, quantile_cont(round(speed, 3), 0.5) AS median FROM speeds", TRAJ), "low high mean median")
def _(spark, d):
    return stats.describe(speeds(spark, d).select(F.round("speed", 3).alias("speed")), "speed")


def _percents(column: str, percents: Iterable[int], table: str) -> str:
    return " UNION ALL ".join(f"SELECT CAST({p} AS INTEGER) AS percent, quantile_cont({column}, {p / 100}) AS value FROM {table}" for p in percents)


@query("a06_duration_quantiles", short(_percents("CAST(n AS DOUBLE)", (5, 10, 25, 50, 75, 90, 95), "(SELECT count(*) AS n FROM tracks GROUP BY track_id)")), "value")
def _(spark, d):
    return stats.quantiles(B(spark, d).groupBy("track_id").agg(F.count("*").alias("n")), "n", [5, 10, 25, 50, 75, 90, 95])


@query("a06_speed_quantiles", long_(_percents("speed", (95, 99), "speeds"), TRAJ), "value")
def _(spark, d):
    return stats.quantiles(speeds(spark, d), "speed", [95, 99])


@query("a14_largest_per_track", long_("SELECT track_id, max(speed) AS speed_max, max(accel) AS accel_max FROM speeds GROUP BY track_id", TRAJ), "speed_max accel_max")
def _(spark, d):
    return stats.largest_per_track(speeds(spark, d))


def _bin(v: str, low: str, high: str, n: int) -> str:
    return f"least(CAST(floor({n}.0::DOUBLE * ({v} - {low}) / ({high} - {low}) + 1) AS INTEGER), {n})"


def _histogram(column: str, table: str, n: int) -> str:
    counts = f"SELECT CASE WHEN low = high THEN {n // 2 + 1} ELSE {_bin(column, 'low', 'high', n)} END AS bin, count(*) AS n FROM {table}, (SELECT min({column}) AS low, max({column}) AS high FROM {table}) WHERE {column} IS NOT NULL GROUP BY 1"
    return f"SELECT CAST(every.bin AS INTEGER) AS bin, CAST(coalesce(counts.n, 0) AS BIGINT) AS count FROM (SELECT unnest(range(1, {n + 1})) AS bin) AS every LEFT JOIN ({counts}) AS counts ON every.bin = counts.bin"


@query("a15_histogram_duration", short(_histogram("n", "(SELECT CAST(count(*) AS DOUBLE) AS n FROM tracks GROUP BY track_id)", 10)))
def _(spark, d):
    return stats.histogram(B(spark, d).groupBy("track_id").agg(F.count("*").cast("double").alias("n")), "n", 10)


@query("a15_histogram_x", long_(_histogram("cx", "tracks", 50)))
def _(spark, d):
    return stats.histogram(A(spark, d), "cx", 50)


@query("a16_histogram_2d", long_(f"SELECT {_bin('cx', 'x0', 'x1', 50)} AS bx, {_bin('cy', 'y0', 'y1', 50)} AS by, count(*) AS count FROM tracks, (SELECT min(cx) AS x0, max(cx) AS x1, min(cy) AS y0, max(cy) AS y1 FROM tracks) GROUP BY 1, 2"))
def _(spark, d):
    return stats.histogram_2d(A(spark, d), "cx", "cy", 50)


# Cleaning ---------------------------------------------------------------------------------------------------------------------------------

FLAG_COLUMNS = ", ".join((*cleaning.FLAGS, "is_noise"))


@query("f05_f06_f07_f08_f09_flags", short(f"SELECT track_id, {FLAG_COLUMNS} FROM flags", TRAJ, METRICS))
def _(spark, d):
    return flags(spark, d).select("track_id", *FLAG_COLUMNS.split(", "))


@query("f09_flags_long", long_(f"SELECT track_id, {FLAG_COLUMNS} FROM flags", TRAJ, METRICS))
def _(spark, d):
    return flags(spark, d, A).select("track_id", *FLAG_COLUMNS.split(", "))


@query("j02_u03_clean_points", short("SELECT speeds.* FROM speeds JOIN flags USING (track_id) WHERE NOT is_noise", TRAJ, METRICS), f"{TRAJ_COLUMNS} speed accel")
def _(spark, d):
    points = speeds(spark, d, B)
    return cleaning.split(points, cleaning.flagged_tracks(points))[0]


@query("j01_u03_noise_points", short("SELECT speeds.* FROM speeds JOIN flags USING (track_id) WHERE is_noise", TRAJ, METRICS), f"{TRAJ_COLUMNS} speed accel")
def _(spark, d):
    points = speeds(spark, d, B)
    return cleaning.split(points, cleaning.flagged_tracks(points))[1]


@query("a12_flag_counts", short(" UNION ALL ".join(f"SELECT '{f}' AS flag, count(*) FILTER ({f}) AS n, avg(CAST({f} AS DOUBLE)) AS fraction FROM flags" for f in (*cleaning.FLAGS, "is_noise")), TRAJ, METRICS), "fraction")
def _(spark, d):
    return cleaning.flag_counts(flags(spark, d))


@query("a22_cleaning_summary", short("""SELECT count(*) AS original_tracks, count(*) FILTER (NOT is_noise) AS clean_tracks, count(*) FILTER (is_noise) AS noise_tracks, 100.0::DOUBLE * count(*) FILTER (is_noise) / count(*) AS noise_pct,
min(duration) FILTER (NOT is_noise) AS clean_min, max(duration) FILTER (NOT is_noise) AS clean_max, avg(duration) FILTER (NOT is_noise) AS clean_mean, min(x_min) AS x_low, max(x_max) AS x_high, min(y_min) AS y_low, max(y_max) AS y_high FROM flags""", TRAJ, METRICS), "noise_pct clean_mean x_low x_high y_low y_high")
def _(spark, d):
    return cleaning.cleaning_summary(flags(spark, d))


# Clusters and outliers ----------------------------------------------------------------------------------------------------------------------

END_COLUMNS = " ".join(clusters.ENDS)


@query("f01_a01_cluster_sizes", long_("SELECT cluster, count(*) AS size FROM labels WHERE cluster >= 0 GROUP BY cluster", *LAB))
def _(spark, d):
    return clusters.cluster_sizes(labels(spark, d))


@query("a11_size_summary", long_("SELECT max(size) AS largest, min(size) AS smallest, avg(size) AS mean, median(size) AS median, count(*) AS n_clusters FROM (SELECT count(*) AS size FROM labels WHERE cluster >= 0 GROUP BY cluster)", *LAB), "mean median")
def _(spark, d):
    return clusters.size_summary(labels(spark, d))


@query("t04_largest_clusters", long_("SELECT cluster, count(*) AS size FROM labels WHERE cluster >= 0 GROUP BY cluster ORDER BY size DESC, cluster LIMIT 4", *LAB))
def _(spark, d):
    return clusters.largest_clusters(labels(spark, d), 4)


@query("a13_a19_p16_u04_outlier_stats", long_("SELECT count(*) FILTER (cluster = -1) AS n_outliers, count(*) AS n_total, 100.0::DOUBLE * count(*) FILTER (cluster = -1) / count(*) AS pct_outliers, max(cluster) + 1 AS n_clusters, count(DISTINCT cluster) FILTER (cluster >= 0) AS n_labels FROM labels", *LAB), "pct_outliers")
def _(spark, d):
    return clusters.outlier_stats(labels(spark, d))


@query("f01_outlier_ids", long_("SELECT track_id FROM labels WHERE cluster = -1", *LAB))
def _(spark, d):
    return clusters.outlier_ids(labels(spark, d))


@query("m02_p17_p18_a18_outliers", long_("SELECT * FROM outliers", *LAB, OUT), f"{END_COLUMNS} reachability")
def _(spark, d):
    return outliers(spark, d)


@query("t02_t03_top_outliers", long_("SELECT * FROM outliers ORDER BY reachability DESC, track_id LIMIT 10", *LAB, OUT), f"{END_COLUMNS} reachability")
def _(spark, d):
    return clusters.top_outliers(outliers(spark, d), 10)


@query("t06_most_anomalous", long_("SELECT track_id, reachability FROM outliers ORDER BY reachability DESC, track_id LIMIT 1", *LAB, OUT), "reachability")
def _(spark, d):
    return clusters.top_outliers(outliers(spark, d), 1).select("track_id", "reachability")


@query("j05_outlier_extents", long_("SELECT o.track_id, o.reachability, count(t.frame) AS duration, min(cx) AS x_min, max(cx) AS x_max, min(cy) AS y_min, max(cy) AS y_max FROM (SELECT * FROM outliers ORDER BY reachability DESC, track_id LIMIT 10) AS o LEFT JOIN tracks AS t ON o.track_id = t.track_id GROUP BY 1, 2", *LAB, OUT), "reachability x_min x_max y_min y_max")
def _(spark, d):
    top = clusters.top_outliers(outliers(spark, d), 10).select("track_id", "reachability")
    return clusters.with_extent(top, A(spark, d).withColumnsRenamed({"cx": "x", "cy": "y"}))


@query("a06_a20_f10_reachability_thresholds", long_(" UNION ALL ".join(f"SELECT CAST({p} AS INTEGER) AS percent, q AS value, (SELECT count(*) FROM outliers WHERE reachability >= q) AS n FROM (SELECT quantile_cont(reachability, {p / 100}) AS q FROM outliers)" for p in (50, 75, 90, 95, 99)), *LAB, OUT), "value")
def _(spark, d):
    return stats.above_thresholds(outliers(spark, d), "reachability", [50, 75, 90, 95, 99])


@query("f10_extreme_outliers", long_("SELECT track_id, reachability FROM outliers WHERE reachability >= (SELECT quantile_cont(reachability, 0.95) FROM outliers)", *LAB, OUT), "reachability")
def _(spark, d):
    found = outliers(spark, d)
    return found.where(F.col("reachability") >= quantiles.exact_quantiles(found, "reachability", [0.95])[0]).select("track_id", "reachability")


@query("j04_c05_clustered_ends", long_("SELECT * FROM clustered", *LAB, CLUSTERED), END_COLUMNS)
def _(spark, d):
    return clustered(spark, d)


@query("a09_p21_p22_c08_centroids", long_("""SELECT *, (x_entry + x_exit) / 2 AS mid_x, (y_entry + y_exit) / 2 AS mid_y, x_exit - x_entry AS dx, y_exit - y_entry AS dy FROM (
SELECT cluster, avg(x_entry) AS x_entry, avg(y_entry) AS y_entry, avg(x_exit) AS x_exit, avg(y_exit) AS y_exit, count(*) AS size FROM clustered GROUP BY cluster)""", *LAB, CLUSTERED), f"{END_COLUMNS} mid_x mid_y dx dy")
def _(spark, d):
    return clusters.centroids(clustered(spark, d))


@query("a10_s11_cluster_summary", long_("SELECT cluster, count(track_id) AS size, " + ", ".join(f"avg({c}) AS {c}_mean, stddev_samp({c}) AS {c}_std" for c in clusters.ENDS) + " FROM clustered GROUP BY cluster", *LAB, CLUSTERED), " ".join(f"{c}_{s}" for c in clusters.ENDS for s in ("mean", "std")))
def _(spark, d):
    return clusters.cluster_summary(clustered(spark, d))


@query("t05_t07_first_tracks", long_("SELECT track_id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY track_id) AS p FROM labels) WHERE p <= 3", *LAB))
def _(spark, d):
    return clusters.first_tracks(labels(spark, d).select("track_id", "cluster"), 3)


@query("f02_c09_cluster_paths", long_("SELECT track_id, frame, cx AS x, cy AS y FROM tracks WHERE track_id IN (SELECT track_id FROM labels WHERE cluster = 2)", *LAB), "x y")
def _(spark, d):
    return charts.cluster_paths(labels(spark, d), A(spark, d).withColumnsRenamed({"cx": "x", "cy": "y"}), 2)


@query("f03_f04_c10_c11_one_track", long_("SELECT track_id, frame, x, y, track_id <> 5 AS background FROM traj", TRAJ), "x y")
def _(spark, d):
    return charts.one_track(moving(spark, d), 5, background=True).drop("dx", "dy")


@query("c01_c02_outlier_arrows", long_("SELECT track_id, x_entry, y_entry, x_exit - x_entry AS dx, y_exit - y_entry AS dy, reachability FROM outliers ORDER BY reachability DESC, track_id LIMIT 50", *LAB, OUT), "x_entry y_entry dx dy reachability")
def _(spark, d):
    return charts.outlier_arrows(outliers(spark, d))


@query("c03_reachability_histogram", long_(_histogram("reachability", "outliers", 30), *LAB, OUT))
def _(spark, d):
    return stats.histogram(outliers(spark, d), "reachability", 30)


@query("c04_size_histogram", long_(_histogram("size", "(SELECT CAST(count(*) AS DOUBLE) AS size FROM labels WHERE cluster >= 0 GROUP BY cluster)", 20), *LAB))
def _(spark, d):
    return stats.histogram(clusters.cluster_sizes(labels(spark, d)).select(F.col("size").cast("double").alias("size")), "size", 20)


TOP = "top AS (SELECT cluster FROM labels WHERE cluster >= 0 GROUP BY cluster ORDER BY count(*) DESC, cluster LIMIT {})"


@query("c06_p22_flow_arrows", long_("SELECT cluster, track_id, x_entry, y_entry, x_exit - x_entry AS dx, y_exit - y_entry AS dy FROM clustered WHERE cluster IN (SELECT cluster FROM top)", *LAB, CLUSTERED, TOP.format(3)), "x_entry y_entry dx dy")
def _(spark, d):
    return charts.flow_arrows(labels(spark, d), clustered(spark, d), 3)


@query("c07_sample_paths", long_("SELECT cluster, t.track_id, frame, cx AS x, cy AS y FROM tracks AS t JOIN (SELECT track_id, cluster, row_number() OVER (PARTITION BY cluster ORDER BY track_id) AS p FROM labels WHERE cluster IN (SELECT cluster FROM top)) AS c ON t.track_id = c.track_id AND p <= 5", *LAB, TOP.format(4)), "x y")
def _(spark, d):
    return charts.sample_paths(labels(spark, d), A(spark, d).withColumnsRenamed({"cx": "x", "cy": "y"}), 4, 5)


@query("c12_duration_histogram", short(_histogram("n", "(SELECT CAST(count(*) AS DOUBLE) AS n FROM tracks GROUP BY track_id)", 50)))
def _(spark, d):
    return stats.histogram(B(spark, d).groupBy("track_id").agg(F.count("*").cast("double").alias("n")), "n", 50)


@query("c14_speed_histogram", long_(_histogram("speed", "(SELECT round(speed, 4) AS speed FROM speeds)", 100), TRAJ))
def _(spark, d):
    return stats.histogram(speeds(spark, d).select(F.round("speed", 4).alias("speed")), "speed", 100)


@query("c15_clean_and_noise", short("SELECT ends.*, is_noise, duration, speed_max FROM ends JOIN flags USING (track_id)", TRAJ, METRICS, ENDS), f"{END_COLUMNS} speed_max")
def _(spark, d):
    return charts.clean_and_noise(tr.entry_exit(B(spark, d), "cx", "cy"), flags(spark, d))


@query("t10_c13_c16_random_rows")
def _(spark, d):
    return stats.random_rows(cleaning.min_max(moving(spark, d)), 100, 42)


# Features and labels --------------------------------------------------------------------------------------------------------------------------

PARTS = {
    "end": ("arg_max(x, frame)", "arg_max(y, frame)"), "end_velocity": ("arg_max(vx, frame)", "arg_max(vy, frame)"), "end_acceleration": ("arg_max(ax, frame)", "arg_max(ay, frame)"),
    "start": ("arg_min(x, frame)", "arg_min(y, frame)"), "middle": ("(list(x ORDER BY frame))[count(*) // 2 + 1]", "(list(y ORDER BY frame))[count(*) // 2 + 1]"),
}


def _vector_sql(spec: features.FeatureSpec) -> str:
    """Float values, compared as doubles at four places."""
    parts = [p for name in PARTS if getattr(spec, name) for p in PARTS[name]]
    return "SELECT track_id, " + ", ".join(f'round(CAST(CAST({p} AS FLOAT) AS DOUBLE), 4) + 0.0 AS "{i}"' for i, p in enumerate(parts)) + " FROM traj GROUP BY track_id"


def _vectors(spec: features.FeatureSpec) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        found = features.vectorise(moving(spark, d), spec)
        return found.select("track_id", *((F.round(F.col(c).cast("double"), 4) + F.lit(0.0)).alias(c) for c in found.columns[1:]))

    return run


for _name, _spec in (*features.PRESETS.items(), ("all", features.FeatureSpec(True, True, True, True, True))):
    query(f"m14_m15_w04_features_{_name.lower()}", long_(_vector_sql(_spec), TRAJ))(_vectors(_spec))


@query("m14_features_short", short("SELECT track_id, round(CAST(CAST(arg_max(x, frame) AS FLOAT) AS DOUBLE), 4) + 0.0 AS x_end, round(CAST(CAST(arg_min(x, frame) AS FLOAT) AS DOUBLE), 4) + 0.0 AS x_start, CAST(6 AS INTEGER) AS width FROM traj GROUP BY track_id", TRAJ))
def _(spark, d):
    spec = features.preset("unknown")
    found = features.vectorise(moving(spark, d, B), spec)
    return found.select("track_id", (F.round(F.col("0").cast("double"), 4) + F.lit(0.0)).alias("x_end"), (F.round(F.col("4").cast("double"), 4) + F.lit(0.0)).alias("x_start"), F.lit(spec.width).alias("width"))


@query("m16_empty_features")
def _(spark, d):
    return features.vectorise(moving(spark, d).where("track_id < 0"), features.preset("ReVeRs"))


@query("j03_m17_labels", long_("SELECT t.track_id, coalesce(l.cluster, -1) AS label FROM (SELECT DISTINCT track_id FROM tracks) AS t LEFT JOIN (SELECT track_id, max(cluster) AS cluster FROM labels WHERE track_id % 2 = 0 GROUP BY track_id) AS l ON t.track_id = l.track_id", *LAB))
def _(spark, d):
    return clusters.labelled(A(spark, d).select("track_id").distinct(), labels(spark, d).where("track_id % 2 = 0"), "cluster")


# Statistics and learning ------------------------------------------------------------------------------------------------------------------------


@query("j09_grid", "SELECT CAST(m AS INTEGER) AS min_samples, x::DOUBLE AS xi, e::DOUBLE AS max_eps FROM (VALUES (10), (20), (30)) AS a(m), (VALUES (0.01), (0.03), (0.05)) AS b(x), (VALUES (0.1), (0.15), (0.2)) AS c(e)", "xi max_eps")
def _(spark, d):
    def one(name: str, values: list, kind: str) -> DataFrame:
        return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")

    return one("min_samples", GRID["min_samples"], "int").crossJoin(one("xi", GRID["xis"], "double")).crossJoin(one("max_eps", GRID["max_eps"], "double"))


POINTS = "points AS (SELECT vec_id AS track_id, label, CAST(embedding AS DOUBLE[]) AS f FROM embeddings)"
KNN = f"""WITH {POINTS}, pairs AS (SELECT a.track_id, b.track_id AS near_id, b.label AS near_label, sqrt(list_sum(list_transform(range(1, len(a.f) + 1), lambda i: (a.f[i] - b.f[i]) * (a.f[i] - b.f[i])))) AS d FROM points AS a, points AS b WHERE a.track_id % 5 = 0 AND b.track_id % 5 <> 0),
best AS (SELECT *, max(CASE WHEN d = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY track_id) AS z FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY d, near_id) AS p FROM pairs) WHERE p <= 7),
votes AS (SELECT track_id, near_label, sum(CASE WHEN z = 1 THEN CASE WHEN d = 0 THEN 1.0 ELSE 0.0 END ELSE 1 / d END) AS vote FROM best GROUP BY 1, 2)
SELECT track_id, near_label AS prediction FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY vote DESC, near_label) AS p FROM votes) WHERE p = 1"""


def points(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("track_id"), F.col("embedding").alias("features"), "label")


@query("m04_j10_nearest_neighbours", KNN)
def _(spark, d):
    rows = points(spark, d)
    return classify.nearest_labels(rows.where("track_id % 5 <> 0"), rows.where("track_id % 5 = 0"))


@query("m11_balanced_accuracy", "SELECT avg(recall) AS balanced_accuracy FROM (SELECT label, avg(CASE WHEN (vec_id * 7) % 10 = label THEN 1.0 ELSE 0.0 END) AS recall FROM embeddings GROUP BY label)", "balanced_accuracy")
def _(spark, d):
    return classify.balanced_accuracy(points(spark, d).withColumn("prediction", (F.col("track_id") * 7 % 10).cast("int")))


@query("m10_stratified_folds", "SELECT label, CAST(fold AS INTEGER) AS fold, (n + 4 - fold) // 5 AS n FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label), (SELECT unnest(range(5)) AS fold)")
def _(spark, d):
    return classify.stratified_folds(points(spark, d), 5, 42).groupBy("label", "fold").agg(F.count("*").alias("n"))


@query("a21_score_summary", "SELECT avg(s) AS mean, stddev_pop(s) AS std FROM (SELECT value AS s FROM events)", "mean std")
def _(spark, d):
    return classify.score_summary(spark.read.parquet(f"{d}/events.parquet").select(F.col("value").alias("score")))


MANN = """WITH ties AS (SELECT round(value, 0) AS v, count(*)::HUGEINT AS n, count(*) FILTER (event_id % 2 = 0)::HUGEINT AS n1 FROM events WHERE value IS NOT NULL GROUP BY 1),
ranked AS (SELECT n1, n1 * (2 * sum(n) OVER (ORDER BY v) - n + 1) AS r2 FROM ties)
SELECT (sum(r2) - sum(n1) * (sum(n1) + 1)) / 2.0::DOUBLE AS u FROM ranked"""


@query("m09_mann_whitney_u", MANN, "u")
def _(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.round("value", 0).alias("score"))
    return classify.mann_whitney(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 <> 0")).select("u")


@query("m01_w08_optics")
def _(spark, d):
    return optics.optics_clusters(ends(spark, d), list(clusters.ENDS), 10, 0.05, 2.0)


@query("m13_f11_t08_grid_search")
def _(spark, d):
    return optics.grid_search(ends(spark, d), list(clusters.ENDS), **GRID).orderBy(F.desc("n_clusters"), "min_samples", "xi", "max_eps")


@query("m03_exit_groups")
def _(spark, d):
    return clusters.exit_groups(ends(spark, d))


def _cross_validated(kind: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: classify.cross_validate(classify.make_model(kind), points(spark, d))


for _kind, _id in (("knn", "m04"), ("svm", "m05"), ("dt", "m06"), ("mlp", "m07")):
    query(f"{_id}_m08_m10_cross_validated_{_kind}")(_cross_validated(_kind))


@query("u01_u02_union", long_("SELECT track_id, frame, cx, cy FROM tracks UNION ALL SELECT track_id, frame, xs, ys FROM (SELECT track_id, frame, cx AS xs, cy AS ys FROM tracks WHERE cls = 2)"), "cx cy")
def _(spark, d):
    rows = A(spark, d).select("track_id", "frame", "cx", "cy", "cls")
    return rows.drop("cls").unionByName(rows.where("cls = 2").drop("cls"))


@query("stream_closed_tracks", long_("""SELECT track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS points, arg_min(cx, frame) AS x_entry, arg_min(cy, frame) AS y_entry, arg_max(cx, frame) AS x_exit, arg_max(cy, frame) AS y_exit FROM tracks GROUP BY track_id"""), END_COLUMNS)
def _(spark, d):
    from .streaming.tracks import closed_tracks

    return closed_tracks(A(spark, d), FPS)
