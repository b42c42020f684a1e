"""The queries of the problems that belong to the core: sessions, timestamps, places near and inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotostrata.operators.sessions import gap_sessions
from fotostrata.operators.spatial import inside_areas, near_links, near_pairs
from fotostrata.operators.timestamps import to_utc
from fotostrata.session import one_per_id, table

#: Fields of metadata_provenance that hold a capture time.
DATE_FIELDS = ["DateTimeOriginal", "CreateDate", "xmp:CreateDate", "photoshop:DateCreated", "2:55,2:60", "Creation Time"]
NEAR_M = 60.0


def wall_micros(ts_ntz) -> F.Column:
    """Microseconds of a wall time since 1970-01-01 on the same clock, whatever the session's zone."""
    minutes = F.unix_date(F.to_date(ts_ntz)).cast("long") * 1440 + F.hour(ts_ntz) * 60 + F.minute(ts_ntz)
    return minutes * 60_000_000 + (F.extract(F.lit("SECOND"), ts_ntz) * 1_000_000).cast("long")


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every session of every camera: camera_id, start_us, end_us, duration_us, n_ops.

    An operation whose config is unknown or sets no window takes part in none.
    """
    configs = table(spark, sf_dir, "organization_configs").groupBy("config_id").agg(
        (F.min("event_window_minutes").cast("long") * 60_000_000).alias("gap_us")
    )
    least = configs.agg(F.min(F.greatest("gap_us", F.lit(0)))).first()[0] or 0
    ops = one_per_id(table(spark, sf_dir, "file_operations").where("chosen_date is not null"), "op_id", "camera_id", "config_id", "chosen_date")
    events = ops.join(configs, "config_id").select("camera_id", "gap_us", wall_micros(F.col("chosen_date")).alias("at_us"))
    return gap_sessions(events, "camera_id", "at_us", "gap_us", least).withColumnRenamed("n_events", "n_ops")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """camera_id, start_us, end_us, n_ops of every session of at least two operations."""
    return sessions(spark, sf_dir).where("n_ops >= 2").select("camera_id", "start_us", "end_us", "n_ops")


def p3_duration_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per camera: sessions (single captures included), captures, longest and total duration."""
    return sessions(spark, sf_dir).groupBy("camera_id").agg(
        F.count(F.lit(1)).alias("n_sessions"),
        F.sum("n_ops").alias("n_ops"),
        F.max("duration_us").alias("longest_us"),
        F.sum("duration_us").alias("total_us"),
    )


P3_SESSIONS_SQL = """
WITH ops AS (
  SELECT op_id, any_value(camera_id) AS camera_id, any_value(config_id) AS config_id, any_value(chosen_date) AS taken
  FROM file_operations WHERE chosen_date IS NOT NULL GROUP BY op_id),
gaps AS (
  SELECT camera_id, epoch_us(taken) AS us, CAST(event_window_minutes AS BIGINT) * 60000000 AS gap_us
  FROM ops JOIN organization_configs USING (config_id) WHERE camera_id IS NOT NULL AND event_window_minutes IS NOT NULL),
marks AS (
  SELECT *, CASE WHEN us - lag(us) OVER w > gap_us OR lag(us) OVER w IS NULL THEN 1 ELSE 0 END AS opens
  FROM gaps WINDOW w AS (PARTITION BY camera_id ORDER BY us)),
numbered AS (
  SELECT *, sum(opens) OVER (PARTITION BY camera_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS session FROM marks),
sessions AS (
  SELECT camera_id, min(us) AS start_us, max(us) AS end_us, CAST(max(us) - min(us) AS BIGINT) AS duration_us, count(*) AS n_ops
  FROM numbered GROUP BY camera_id, session)
"""
P3_FOUND_SQL = P3_SESSIONS_SQL + "SELECT camera_id, start_us, end_us, n_ops FROM sessions WHERE n_ops >= 2"
P3_SUMMARY_SQL = P3_SESSIONS_SQL + """
SELECT camera_id, count(*) AS n_sessions, CAST(sum(n_ops) AS BIGINT) AS n_ops, max(duration_us) AS longest_us,
       CAST(sum(duration_us) AS BIGINT) AS total_us FROM sessions GROUP BY camera_id"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_table, record_id, utc_us of every value with a date and time of day whose zone is known."""
    rules = one_per_id(table(spark, sf_dir, "correction_rules"), "rule_id", "timezone", "clock_offset")
    prov = one_per_id(
        table(spark, sf_dir, "metadata_provenance").where(F.col("field").isin(*DATE_FIELDS) & F.col("raw_value").isNotNull()),
        "prov_id", "rule_id", "raw_value",
    ).join(rules, "rule_id", "left")
    journal = one_per_id(table(spark, sf_dir, "journal_entries").where("date_value is not null and date_value <> ''"), "entry_id", "date_value")
    from_prov = to_utc(prov, "raw_value", "timezone", "clock_offset").select(
        F.lit("metadata_provenance").alias("source_table"), F.col("prov_id").alias("record_id"), known(F.col("utc_us")).alias("utc_us")
    )
    from_journal = to_utc(journal, "date_value").select(
        F.lit("journal_entries").alias("source_table"), F.col("entry_id").alias("record_id"), known(F.col("utc_us")).alias("utc_us")
    )
    return from_prov.unionByName(from_journal)


def known(value) -> F.Column:
    """Keeps the rows where ``value`` is not null, by exploding a list of it.

    A filter would be pushed below every projection that made the value, with
    all their expressions repeated in it.
    """
    return F.explode(F.array_compact(F.array(value)))


def _captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, lat, lon, owner of every operation with coordinates and a camera."""
    raw = table(spark, sf_dir, "file_operations")
    return one_per_id(
        raw.where("camera_id is not null").select("op_id", "camera_id", F.col("coordinates.latitude").alias("lat"), F.col("coordinates.longitude").alias("lon"))
        .where("lat is not null and lon is not null"),
        "op_id", "lat", "lon", "camera_id",
    ).select(F.col("op_id").alias("id"), "lat", "lon", F.col("camera_id").alias("owner"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """relation, a_id, b_id: captures of different cameras at most 60 m apart; locations inside areas."""
    near = near_pairs(_captures(spark, sf_dir), NEAR_M, rows=table(spark, sf_dir, "file_operations").count())
    places = table(spark, sf_dir, "reverse_geocoded_locations")
    locations = one_per_id(places, "location_id", "latitude", "longitude").select(
        F.col("location_id").alias("id"), F.col("latitude").alias("lat"), F.col("longitude").alias("lon")
    )
    areas = one_per_id(table(spark, sf_dir, "geo_areas"), "area_id", "shape_wkt").select("area_id", F.col("shape_wkt").alias("wkt"))
    inside = inside_areas(locations, areas, rows=places.count())
    return near.select(F.lit("near").alias("relation"), "a_id", "b_id").unionByName(
        inside.select(F.lit("inside").alias("relation"), F.col("point_id").alias("a_id"), F.col("area_id").alias("b_id"))
    )


def p6_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op_id, class_id, n_links: each located capture with its class (one camera at one place) and how many captures of other cameras lie within 60 m."""
    return near_links(_captures(spark, sf_dir), NEAR_M).select(F.col("id").alias("op_id"), "class_id", "n_links")


_NEAR_SQL = """
WITH o AS (
  SELECT op_id, any_value(camera_id) AS camera_id, any_value(coordinates.latitude) AS lat, any_value(coordinates.longitude) AS lon
  FROM file_operations WHERE camera_id IS NOT NULL AND coordinates.latitude IS NOT NULL AND coordinates.longitude IS NOT NULL GROUP BY op_id),
g AS (SELECT * FROM o WHERE lat BETWEEN -90 AND 90 AND lon BETWEEN -180 AND 180 AND NOT (lat = 0 AND lon = 0)),
n AS (
  SELECT a.op_id AS a_id, b.op_id AS b_id FROM g a JOIN g b ON a.op_id < b.op_id AND a.camera_id <> b.camera_id AND abs(a.lat - b.lat) < 0.001
  WHERE 2 * 6371000 * asin(sqrt(least(1, sin(radians(b.lat - a.lat) / 2) ** 2 + cos(radians(a.lat)) * cos(radians(b.lat)) * sin(radians(b.lon - a.lon) / 2) ** 2))) <= 60)
"""
P6_FOUND_SQL = _NEAR_SQL + r""",
l AS (SELECT location_id, any_value(longitude) AS x, any_value(latitude) AS y FROM reverse_geocoded_locations GROUP BY location_id),
r AS (SELECT area_id, unnest(regexp_extract_all(any_value(shape_wkt), '\(([^()]+)\)', 1)) AS ring FROM geo_areas GROUP BY area_id),
p AS (SELECT area_id, list_transform(string_split(ring, ','), lambda t: [CAST(string_split(trim(t), ' ')[1] AS DOUBLE), CAST(string_split(trim(t), ' ')[2] AS DOUBLE)]) AS pts FROM r),
k AS (SELECT area_id, pts, unnest(range(1, len(pts) + 1)) AS i FROM p),
e AS (SELECT area_id, pts[i][1] AS x1, pts[i][2] AS y1, pts[i % len(pts) + 1][1] AS x2, pts[i % len(pts) + 1][2] AS y2 FROM k),
c AS (SELECT location_id, area_id FROM l JOIN e ON (y1 > y) <> (y2 > y) WHERE x < (x2 - x1) * (y - y1) / (y2 - y1) + x1)
SELECT 'near' AS relation, a_id, b_id FROM n
UNION ALL SELECT 'inside', location_id, area_id FROM c GROUP BY location_id, area_id HAVING count(*) % 2 = 1"""
P6_LINKS_SQL = _NEAR_SQL + """,
b AS (SELECT a_id AS op_id, count(*) AS n FROM (SELECT a_id FROM n UNION ALL SELECT b_id FROM n) GROUP BY a_id)
SELECT op_id, min(op_id) OVER (PARTITION BY lat, lon, camera_id) AS class_id, coalesce(n, 0) AS n_links FROM g LEFT JOIN b USING (op_id)"""

QUERIES = {"p3_found": p3_found, "p3_duration_summary": p3_duration_summary, "p5_found": p5_found, "p6_found": p6_found, "p6_links": p6_links}
ORACLES = {"p3_found": P3_FOUND_SQL, "p3_duration_summary": P3_SUMMARY_SQL, "p6_found": P6_FOUND_SQL, "p6_links": P6_LINKS_SQL}
