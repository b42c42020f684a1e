"""Queries of the engine's own operators on the given tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotostrata.functions import dates, gps, paths, text
from fotostrata.operators import destinations, duplicates, events, location, lookup, naming, reconcile, review, rules
from fotostrata.plans import execute
from fotostrata.session import one_per_id, table
from fotostrata.sources import manifest

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def ntz(column) -> F.Column:
    return F.col(column).cast("timestamp_ntz") if isinstance(column, str) else column.cast("timestamp_ntz")


def text_of(ts) -> F.Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# ------------------------------------------------------------------ duplicates


def _hashed_documents(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select(F.format_string("%012d", "doc_id").alias("path"), duplicates.content_hash(F.col("text")).alias("hash"))


@query("""
WITH h AS (SELECT printf('%012d', doc_id) AS path, sha256(text) AS hash FROM documents WHERE text IS NOT NULL),
g AS (SELECT hash AS content_hash, list_sort(list(path)) AS paths, count(*) AS n_files FROM h GROUP BY hash HAVING count(*) > 1)
SELECT row_number() OVER (ORDER BY paths[1], content_hash) AS group_id, content_hash, paths[1] AS original,
       CASE WHEN n_files <= 1000 THEN array_to_string(paths[2:], ';') END AS duplicates, n_files FROM g""")
def dedupe_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identical documents: original, and the duplicates in order of groups of up to a thousand."""
    return duplicates.duplicate_groups(_hashed_documents(spark, sf_dir), list_up_to=1_000).withColumn("duplicates", F.array_join("duplicates", ";"))


@query("""
WITH h AS (SELECT printf('%012d', doc_id) AS path, sha256(text) AS hash FROM documents WHERE text IS NOT NULL),
g AS (SELECT hash, min(path) AS original FROM h GROUP BY hash HAVING count(*) > 1)
SELECT path, hash AS content_hash, original, CASE WHEN path = original THEN 'original' ELSE 'duplicate' END AS role FROM h JOIN g USING (hash)""")
def dedupe_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_members(_hashed_documents(spark, sf_dir)).select("path", "content_hash", "original", "role")


@query("""
WITH g AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1)
SELECT count(*) AS n_groups, CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS n_duplicates, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_files FROM g""")
def dedupe_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.duplicate_summary(_hashed_documents(spark, sf_dir))


@query("""
SELECT a.doc_id AS a_id, b.doc_id AS b_id, sha256(a.text) = sha256(b.text) AS same
FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL""")
def hash_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether neighbouring documents are byte for byte the same, by hash."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", duplicates.content_hash(F.col("text")).alias("h"))
    later = docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("doc_id").alias("b_id"), F.col("h").alias("h2"))
    return docs.join(later, "doc_id").select(F.col("doc_id").alias("a_id"), "b_id", (F.col("h") == F.col("h2")).alias("same"))


# ------------------------------------------------------------------ reconciliation


def _candidates(spark, sf_dir) -> DataFrame:
    """Per order: its date (rank 0), first and last shipping dates (1, 2), and the day of its last line as the file system's (9)."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("path"), ntz("o_orderdate").alias("ordered"))
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("path")).agg(F.min("l_shipdate").alias("first"), F.max("l_shipdate").alias("last"))
    facts = orders.join(lines, "path", "left")
    shapes = [("ordered", "EXIF", "DateTimeOriginal", 0), ("first", "EXIF", "CreateDate", 1), ("last", "XMP", "xmp:CreateDate", 2), ("last", "filesystem", "mtime", 9)]
    rows = [
        F.struct(
            F.lit(i).alias("seq"), ntz(c).alias("value"), F.lit(s).alias("source"), F.lit(f).alias("field"), F.lit("medium").alias("confidence"), F.lit(None).cast("string").alias("raw_value"),
            F.lit("primary" if not r else "fallback").alias("role"), F.lit(r).alias("precedence"), F.lit(r >= 5).alias("used_fallback"), F.lit("captured" if r < 5 else "inferred").alias("date_kind"),
        )
        for i, (c, s, f, r) in enumerate(shapes)
    ]
    return facts.select("path", F.explode(F.array(*rows)).alias("c")).select("path", "c.*").where("value is not null")


_CANDIDATES_SQL = """
WITH s AS (SELECT l_orderkey, min(l_shipdate) AS f, max(l_shipdate) AS l FROM lineitem GROUP BY 1),
c AS (SELECT o_orderkey AS path, 0 AS seq, o_orderdate AS v, 'EXIF:DateTimeOriginal' AS label, 0 AS p FROM orders
 UNION ALL SELECT o_orderkey, 1, f, 'EXIF:CreateDate', 1 FROM orders JOIN s ON l_orderkey = o_orderkey
 UNION ALL SELECT o_orderkey, 2, l, 'XMP:xmp:CreateDate', 2 FROM orders JOIN s ON l_orderkey = o_orderkey
 UNION ALL SELECT o_orderkey, 3, l, 'filesystem:mtime', 9 FROM orders JOIN s ON l_orderkey = o_orderkey),
r AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY {order}) AS n, count(DISTINCT v) OVER (PARTITION BY path) > 1 AS conflict FROM c WHERE v IS NOT NULL)
SELECT path, strftime(v, '%Y-%m-%d %H:%M:%S') AS value, label, conflict FROM r WHERE n = 1"""


def _reconciled(spark, sf_dir, policy) -> DataFrame:
    got = reconcile.reconcile(_candidates(spark, sf_dir), policy)
    return got.select("path", text_of(F.col("selected.value")).alias("value"), F.concat_ws(":", "selected.source", "selected.field").alias("label"), "conflict")


@query(_CANDIDATES_SQL.format(order="p, seq"))
def reconcile_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir, "precedence")


@query(_CANDIDATES_SQL.format(order="v DESC, p, seq"))
def reconcile_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir, "newest")


@query(_CANDIDATES_SQL.format(order="v, p, seq"))
def reconcile_oldest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir, "oldest")


@query(_CANDIDATES_SQL.format(order="CASE WHEN label LIKE 'filesystem%' THEN 0 ELSE 1 END, p, seq"))
def reconcile_filesystem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reconciled(spark, sf_dir, "filesystem")


@query("""
SELECT l_orderkey AS path, strftime(l_shipdate, '%Y-%m-%d') AS value, l_returnflag AS canonical, min(l_linenumber) AS seq
FROM lineitem GROUP BY l_orderkey, l_shipdate, l_returnflag""")
def candidate_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("path"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("value"), F.col("l_returnflag").alias("canonical"), F.col("l_linenumber").alias("seq")
    )
    return reconcile.drop_repeated_candidates(rows).select("path", "value", "canonical", "seq")


@query("""
SELECT source, field, count(*) AS n, CASE WHEN source = 'EXIF' AND field = 'DateTimeOriginal' THEN 0 WHEN source = 'EXIF' AND field = 'CreateDate' THEN 1
 WHEN source IN ('XMP', 'XMP sidecar') AND field IN ('exif:DateTimeOriginal', 'xmp:CreateDate') THEN 2 WHEN source = 'IPTC-IIM' AND field = '2:55,2:60' THEN 3
 WHEN source = 'PNG metadata' AND field IN ('Creation Time', 'CreationTime', 'tIME') THEN 4 ELSE 13 END AS rank
FROM metadata_provenance GROUP BY source, field""")
def precedence_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "metadata_provenance").groupBy("source", "field").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("source", "field", "n", reconcile.rank_of(F.col("source"), F.col("field")).alias("rank"))


# ------------------------------------------------------------------ events and bursts


def _events(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", ntz("ts").alias("at"), F.format_string("%012d", "event_id").alias("source"))


_SESSIONS_SQL = """
WITH m AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= {gap} THEN 0 ELSE 1 END AS o
 FROM events WINDOW w AS (PARTITION BY {part} ORDER BY ts, event_id)),
g AS (SELECT *, sum(o) OVER (PARTITION BY {part} ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS k FROM m),
s AS (SELECT *, count(*) OVER (PARTITION BY {part}, k) AS n, min(us) OVER (PARTITION BY {part}, k) AS b, max(us) OVER (PARTITION BY {part}, k) AS e FROM g)
"""


@query(_SESSIONS_SQL.format(gap=43_200_000_000, part="user_id") + "SELECT event_id, user_id, CAST(k AS BIGINT) AS group_index, n AS group_size, b AS group_start_us, e AS group_end_us FROM s")
def event_sessions_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.gap_groups(_events(spark, sf_dir), "at", 43_200_000_000, "source", "user_id")
    return got.select("event_id", "user_id", "group_index", "group_size", "group_start_us", "group_end_us")


@query(_SESSIONS_SQL.format(gap=300_000_000, part="1") + """SELECT event_id, printf('event-%03d', CAST(k AS BIGINT)) AS temporal_event_id,
 printf('event-%03d', CAST(k AS BIGINT)) || strftime(make_timestamp(b), '_%Y-%m-%d_%H-%M') AS label, n AS size FROM s""")
def temporal_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over all rows with a gap of five minutes, numbered in order of time."""
    grouped = events.event_columns(events.gap_groups(_events(spark, sf_dir).withColumnRenamed("event_id", "id"), "at", 300_000_000, "source"), 5)
    return grouped.select(F.col("id").alias("event_id"), F.col("event_id").alias("temporal_event_id"), F.col("event_label").alias("label"), F.col("group_size").alias("size"))


@query(_SESSIONS_SQL.format(gap=43_200_000_000, part="user_id") + """
, f AS (SELECT user_id, k, event_type, count(*) AS c FROM s GROUP BY ALL)
SELECT user_id, CAST(k AS BIGINT) AS group_index, event_type AS folder FROM (SELECT *, row_number() OVER (PARTITION BY user_id, k ORDER BY c DESC, event_type) AS r FROM f) WHERE r = 1""")
def event_folder_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.gap_groups(_events(spark, sf_dir), "at", 43_200_000_000, "source", "user_id")
    return events.most_frequent(got, ["user_id", "group_index"], "event_type", "folder")


@query(_SESSIONS_SQL.format(gap=43_200_000_000, part="user_id") + """
, q AS (SELECT *, dense_rank() OVER (PARTITION BY user_id ORDER BY k) AS i FROM s WHERE n >= 3)
SELECT event_id, user_id, printf('burst-%03d', i) AS burst_group_id, 'REVIEW_BURST' AS burst_mark, 'temporal gap <= 43200s' AS burst_reason, n AS burst_group_size FROM q
UNION ALL SELECT event_id, user_id, '', '', '', 0 FROM s WHERE n < 3""")
def bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = events.mark_bursts(_events(spark, sf_dir), "at", "source", 43_200, 3, entity="user_id")
    blank = [F.coalesce(c, F.lit("")).alias(c) for c in ("burst_group_id", "burst_mark", "burst_reason")]
    return got.select("event_id", "user_id", *blank, F.coalesce("burst_group_size", F.lit(0)).alias("burst_group_size"))


@query()
def burst_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bursts of each camera's captures confirmed by similar names; difflib's ratio has no SQL."""
    ops = one_per_id(table(spark, sf_dir, "file_operations").where("chosen_date is not null"), "op_id", "camera_id", "source", "chosen_date")
    rows = ops.select("op_id", "camera_id", "source", "chosen_date", paths.stem(F.col("source")).alias("stem"))
    got = events.mark_bursts(rows, "chosen_date", "source", 2, 3, similarity=0.8, entity="camera_id")
    return got.where("burst_group_id is not null").select("op_id", "camera_id", "burst_group_id", "burst_mark", "burst_reason", "burst_group_size")


# ------------------------------------------------------------------ rules

RULES = [
    rules.Rule("glob", "1-*", city="Paraty", state="RJ", event="Archive"),
    rules.Rule("glob", "*-BUILDING/*", city="Lisboa", clock_offset="+01:30"),
    rules.Rule("folder", "2-HIGH", state="SP", date="1970-01-02T03:04:05", priority="highest"),
    rules.Rule("camera_model", "machinery*", country="Brasil", event="Works"),
]


@query("""
WITH c AS (SELECT o_orderkey, o_orderpriority || '/' || o_orderkey AS rel, lower(c_mktsegment) AS model FROM orders JOIN customer ON o_custkey = c_custkey),
m AS (SELECT o_orderkey, rel LIKE '1-%' AS a, rel LIKE '%-BUILDING/%' AS b, starts_with(rel, '2-HIGH/') AS f, model LIKE 'machinery%' AS k FROM c)
SELECT o_orderkey, CASE WHEN b THEN 'Lisboa' WHEN a THEN 'Paraty' END AS city, CASE WHEN f THEN 'SP' WHEN a THEN 'RJ' END AS state, CASE WHEN k THEN 'Brasil' END AS country,
 CASE WHEN k THEN 'Works' WHEN a THEN 'Archive' END AS event, CASE WHEN b THEN '+01:30' END AS clock_offset, CASE WHEN k THEN 'metadata' WHEN f THEN 'highest' WHEN b OR a THEN 'metadata' END AS priority
FROM m WHERE a OR b OR f OR k""")
def correction_rules_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered rules over orders by priority and customer segment; per field the last value wins."""
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    files = orders.select("o_orderkey", F.concat_ws("/", "o_orderpriority", "o_orderkey").alias("relative"), F.col("o_orderkey").cast("string").alias("name"), F.lit("x").alias("make"), F.col("c_mktsegment").alias("model"))
    got = rules.apply_rules(files, RULES, "metadata").where("correction is not null")
    return got.select("o_orderkey", *[F.col(f"correction.{k}").alias(k) for k in ("city", "state", "country", "event", "clock_offset", "priority")])


@query("""
WITH r AS (SELECT rule_id, any_value(selector_type) AS kind, any_value(selector) AS s, any_value(camera_make) AS mk, any_value(camera_model) AS md, any_value(city) AS city, any_value(country) AS country, any_value(event_name) AS event,
  any_value(clock_offset) AS clock_offset, any_value(priority) AS priority FROM correction_rules GROUP BY rule_id),
q AS (SELECT *, trim(replace(coalesce(s, ''), chr(92), '/')) AS t, trim(trim(replace(coalesce(s, ''), chr(92), '/')), '/') AS b FROM r),
f AS (SELECT op_id, regexp_replace(any_value(source), '^/', '') AS rel, regexp_extract(any_value(source), '([^/]*)/*$', 1) AS name, lower(trim(any_value(camera_make))) AS mk, lower(trim(any_value(camera_model))) AS md FROM file_operations GROUP BY op_id),
h AS (SELECT op_id, q.* FROM f JOIN q ON
  (kind = 'file' AND (rel = b OR name = t)) OR (kind = 'folder' AND (b IN ('', '.') OR starts_with(rel, b || '/'))) OR (kind IN ('glob', 'pattern') AND (rel GLOB t OR name GLOB t))
  OR (kind = 'camera_make' AND f.mk = lower(trim(coalesce(q.mk, s)))) OR (kind = 'camera_profile' AND (q.mk IS NULL OR f.mk = lower(trim(q.mk))) AND (q.md IS NULL OR f.md = lower(trim(q.md)))))
SELECT op_id, arg_max(city, rule_id) FILTER (city IS NOT NULL) AS city, arg_max(country, rule_id) FILTER (country IS NOT NULL) AS country, arg_max(event, rule_id) FILTER (event IS NOT NULL) AS event,
 arg_max(clock_offset, rule_id) FILTER (clock_offset IS NOT NULL) AS clock_offset, arg_max(coalesce(priority, 'metadata'), rule_id) AS priority, count(*) AS n_rules FROM h GROUP BY op_id""")
def correction_rule_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of correction_rules, in order of rule_id, over every operation; the selectors are paths below the root folder."""
    given = one_per_id(table(spark, sf_dir, "correction_rules"), "rule_id", "selector_type", "selector", "camera_make", "camera_model", "date_value", "timezone", "clock_offset", "city", "state", "country", "event_name", "priority")
    given = given.withColumnsRenamed({"date_value": "date", "event_name": "event"})
    ops = one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "source", "camera_make", "camera_model")
    files = ops.select("op_id", F.regexp_replace("source", "^/", "").alias("relative"), paths.name(F.col("source")).alias("name"), F.col("camera_make").alias("make"), F.col("camera_model").alias("model"))
    got = rules.apply_rule_table(files, given, "op_id", "metadata").where("correction is not null")
    return got.select("op_id", *[F.col(f"correction.{k}").alias(k) for k in ("city", "country", "event", "clock_offset", "priority")], F.size("correction.selectors").cast("long").alias("n_rules"))


@query("""
WITH r AS (SELECT rule_id, any_value(clock_offset) AS c FROM correction_rules GROUP BY rule_id),
t AS (SELECT rule_id, trim(c, ' ' || chr(9) || chr(10)) AS t FROM r WHERE c IS NOT NULL),
p AS (SELECT rule_id, t, CASE WHEN t LIKE '-%' THEN -1 ELSE 1 END AS s, ltrim(t, '+-') AS u FROM t)
SELECT rule_id, coalesce(CAST(CAST(s * CASE WHEN regexp_full_match(t, '[+-]?\\d{1,3}[dD]') THEN CAST(u[:-2] AS BIGINT) * 86400 WHEN regexp_full_match(t, '[+-]?\\d{1,4}[hH]') THEN CAST(u[:-2] AS BIGINT) * 3600
 WHEN regexp_full_match(t, '[+-]?\\d{1,2}(:?\\d{2})?') THEN CASE
  WHEN CAST(CASE WHEN length(replace(u, ':', '')) <= 2 THEN u ELSE replace(u, ':', '')[:-3] END AS BIGINT) <= 23 AND CAST(CASE WHEN length(replace(u, ':', '')) <= 2 THEN '0' ELSE u[-2:] END AS BIGINT) <= 59
  THEN CAST(CASE WHEN length(replace(u, ':', '')) <= 2 THEN u ELSE replace(u, ':', '')[:-3] END AS BIGINT) * 3600 + CAST(CASE WHEN length(replace(u, ':', '')) <= 2 THEN '0' ELSE u[-2:] END AS BIGINT) * 60 END END AS BIGINT) AS VARCHAR), 'invalid') AS seconds FROM p""")
def clock_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = one_per_id(table(spark, sf_dir, "correction_rules").where("clock_offset is not null"), "rule_id", "clock_offset")
    return given.select("rule_id", F.coalesce(dates.clock_offset_seconds(F.col("clock_offset")).cast("string"), F.lit("invalid")).alias("seconds"))


@query("SELECT event_id, strftime(ts - INTERVAL 5400 SECOND, '%Y-%m-%d %H:%M:%S') AS shifted FROM events")
def clock_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", text_of(dates.shift_clock(F.col("at"), dates.clock_offset_seconds(F.lit("-01:30")))).alias("shifted"))


# ------------------------------------------------------------------ names and folders


@query("SELECT event_id, strftime(ts, '%Y-%m-%d_%H-%M-%S') || '.' || event_type AS name FROM events")
def default_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", destinations.default_name(F.col("at"), F.concat(F.lit("."), F.col("event_type"))).alias("name"))


@query("SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type || '.jpg' AS name FROM events")
def pattern_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = destinations.pattern_name("{date:%Y%m%d_%H%M%S}_{stem}{ext}", F.col("at"), F.col("event_type"), F.lit(".jpg"), F.col("source"))
    return _events(spark, sf_dir).select("event_id", name.alias("name"))


@query("SELECT event_id, 'out/' || strftime(ts, '%Y/%m/%d') AS folder FROM events")
def date_destination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select("event_id", destinations.date_folder(F.lit("out"), F.col("at")).alias("folder"))


_PLACED_SQL = "FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _placed_orders(spark, sf_dir) -> DataFrame:
    names = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    # the few place names are normalized once each, not once per order
    names = names.withColumns({"state": destinations.part(F.col("n_name")), "country": destinations.part(F.col("r_name"))})
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(names, F.col("c_nationkey") == F.col("n_nationkey"))
    return orders.select("o_orderkey", ntz("o_orderdate").alias("at"), "state", "country", F.col("c_mktsegment").alias("city"))


@query(f"SELECT o_orderkey, 'out/' || r_name || '/' || n_name || '/' || c_mktsegment AS location, 'out/' || r_name || '/' || n_name || '/' || c_mktsegment || strftime(o_orderdate, '/%Y/%m') AS location_date, 'out/' || c_mktsegment || '-' || n_name || strftime(o_orderdate, '/%Y-%m') AS city_state_month, 'out/' || strftime(o_orderdate, '%Y') || '/' || c_mktsegment AS pattern {_PLACED_SQL}")
def place_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folders by place, place and date, city and month, and by pattern."""
    base, c = F.lit("out"), F.col
    return _placed_orders(spark, sf_dir).select(
        "o_orderkey",
        destinations.place_folder(base, c("country"), c("state"), c("city")).alias("location"),
        destinations.place_date_folder(base, c("country"), c("state"), c("city"), c("at")).alias("location_date"),
        destinations.city_month_folder(base, c("state"), c("city"), c("at"), F.lit(False)).alias("city_state_month"),
        destinations.pattern_folder(base, c("at"), "{date:%Y}/{city}", c("country"), c("state"), c("city")).alias("pattern"),
    )


@query(f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'out/' || strftime(o_orderdate, '%Y/%m/%d') ELSE 'out/' || r_name || '/' || n_name || '/' || c_mktsegment END AS folder, o_orderkey % 3 = 0 AS fallback {_PLACED_SQL}")
def strategy_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The location strategy with every third order lacking a place."""
    rows = _placed_orders(spark, sf_dir).withColumn("place", F.when(F.col("o_orderkey") % 3 != 0, F.struct("country", "state", "city")))
    folder, fallback = destinations.choose_folder("location", None, F.lit("out"), F.col("at"), F.col("place"), F.lit(False))
    return rows.select("o_orderkey", folder.alias("folder"), fallback.alias("fallback"))


@query("SELECT event_id, 'out/Derivatives/' || strftime(ts, '%Y/%m/%d') AS derived, 'out/label/' || strftime(ts, '%Y/%m/%d') || '/f.jpg' AS labelled FROM events")
def moved_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derivative subtree and the event folder of a date folder."""
    folder = destinations.date_folder(F.lit("out"), F.col("at"))
    return _events(spark, sf_dir).select(
        "event_id", destinations.derived_folder(folder, F.lit("out"), "Derivatives").alias("derived"), destinations.event_folder(F.concat_ws("/", folder, F.lit("f.jpg")), F.lit("out"), F.lit("label")).alias("labelled")
    )


def _hourly(spark, sf_dir) -> DataFrame:
    return _events(spark, sf_dir).select("source", F.concat(F.lit("out/"), F.date_format("at", "yyyy-MM-dd_HH"), F.lit(".jpg")).alias("destination"))


@query("""
WITH p AS (SELECT printf('%012d', event_id) AS source, 'out/' || strftime(ts, '%Y-%m-%d_%H') AS stem, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) - 1 AS k FROM events)
SELECT source, stem || '.jpg' AS destination, stem || CASE WHEN k = 0 THEN '' ELSE printf('_%02d', k) END || '.jpg' AS final_destination FROM p""")
def conflict_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of one hour want the same name; later ones are numbered."""
    return naming.resolve_destinations(_hourly(spark, sf_dir))


@query("""
WITH p AS (SELECT printf('%012d', event_id) AS source, 'out/' || strftime(ts, '%Y-%m-%d_%H') || '.jpg' AS d, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS k FROM events)
SELECT source, d AS destination, CASE WHEN k = 1 THEN d END AS final_destination FROM p""")
def conflict_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.resolve_destinations(_hourly(spark, sf_dir), policy="skip")


@query("""
WITH p AS (SELECT printf('%012d', event_id) AS source, 'out/' || strftime(ts, '%Y-%m-%d_%H') || '.jpg' AS d, row_number() OVER (PARTITION BY date_trunc('hour', ts) ORDER BY event_id) AS k FROM events)
SELECT policy, source, CASE WHEN k = 1 THEN d END AS final_destination FROM p, (VALUES ('overwrite-never'), ('quarantine')) v(policy)""")
def conflict_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The policies that never rename: the first source keeps the name."""
    one = lambda policy: naming.resolve_destinations(_hourly(spark, sf_dir), policy=policy).select(F.lit(policy).alias("policy"), "source", "final_destination")
    return one("overwrite-never").unionByName(one("quarantine"))


@query()
def conflict_mixed_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Natural names like x_01 among numbered ones: resolved step by step within a family."""
    rows = _hourly(spark, sf_dir).withColumn("destination", F.when(F.col("source").cast("long") % 7 == 0, F.regexp_replace("destination", r"\.jpg$", "_01.jpg")).otherwise(F.col("destination")))
    return naming.resolve_destinations(rows)


# ------------------------------------------------------------------ journal and joins


_DONE_SQL = "(SELECT source FROM journal_entries WHERE status = 'success' AND source <> '')"


def _resumed(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    return execute.split_resumable(one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "source"), table(spark, sf_dir, "journal_entries"))


@query(f"SELECT op_id, any_value(source) AS source FROM file_operations WHERE source IS NULL OR source NOT IN {_DONE_SQL} GROUP BY op_id")
def resume_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that the journal does not say succeeded."""
    return _resumed(spark, sf_dir)[0].select("op_id", "source")


@query(f"SELECT op_id, any_value(source) AS source FROM file_operations WHERE source IN {_DONE_SQL} GROUP BY op_id")
def resume_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operations that a run with this journal leaves out."""
    return _resumed(spark, sf_dir)[1].select("op_id", "source")


@query(f"SELECT DISTINCT source FROM {_DONE_SQL}")
def journal_completed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.completed_sources(table(spark, sf_dir, "journal_entries"))


@query("""
WITH o AS (SELECT op_id, any_value(source) AS source FROM file_operations GROUP BY op_id),
j AS (SELECT source, arg_max(status, entry_id) AS status FROM journal_entries WHERE source IS NOT NULL GROUP BY source)
SELECT op_id, coalesce(status, 'planned') AS status FROM o LEFT JOIN j USING (source)""")
def plan_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each operation with the outcome its journal gives last."""
    ops = one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "source")
    last = table(spark, sf_dir, "journal_entries").where("source is not null").groupBy("source").agg(F.max_by("status", "entry_id").alias("status"), F.count(F.lit(1)).alias("n"))
    known = lookup.skewed_lookup(ops, last, ["source"], "n")
    rest = ops.join(last.select("source"), "source", "left_anti").select("op_id", F.lit("planned").alias("status"))
    return known.select("op_id", "status").unionByName(rest)


@query("""
WITH n AS (SELECT n_name, n_regionkey, CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 5 = 0 THEN 'odd' ELSE 'even' END AS v FROM nation)
SELECT a.n_name, CASE WHEN count(DISTINCT b.v) = 1 THEN min(b.v) END AS agreed, CASE WHEN count(b.v) = 1 THEN min(b.v) END AS single
FROM n a LEFT JOIN n b ON a.n_regionkey = b.n_regionkey AND a.n_name <> b.n_name GROUP BY a.n_name""")
def sibling_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the other nations of a region agree on, and what the only other one with a value has."""
    k = F.col("n_nationkey")
    rows = table(spark, sf_dir, "nation").select("n_name", "n_regionkey", F.when(k % 4 == 0, F.lit(None)).when(k % 5 == 0, "odd").otherwise("even").alias("v"))
    both = location.only_other(location.only_other(rows, "n_name", "n_regionkey", "v", "agreed", True), "n_name", "n_regionkey", "v", "single", False)
    return both.select("n_name", "agreed", "single")


# ------------------------------------------------------------------ texts, dates, coordinates


@query("""
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 2 = 0 THEN ' 10:20:30' ELSE ' 00:00:00' END AS value FROM orders""")
def path_text_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates written into names, with and without a time, and read back."""
    even = F.col("o_orderkey") % 2 == 0
    name = F.concat(F.lit("IMG_"), F.date_format("o_orderdate", "yyyyMMdd"), F.when(even, "_102030").otherwise(""), F.lit("-x"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text_of(dates.name_date(name)["value"]).alias("value"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS exif, strftime(o_orderdate, '%Y-%m-%d 12:34:56') AS iptc, NULL AS bad FROM orders")
def camera_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXIF dates with a zone that is dropped, IPTC dates, and a day that does not exist."""
    d = F.col("o_orderdate")
    exif = dates.exif_datetime(F.concat(F.date_format(d, "yyyy:MM:dd HH:mm:ss"), F.lit("+02:00")))
    iptc = dates.iptc_datetime(F.date_format(d, "yyyyMMdd"), F.lit("123456+0100"))
    return table(spark, sf_dir, "orders").select("o_orderkey", text_of(exif).alias("exif"), text_of(iptc).alias("iptc"), text_of(dates.exif_datetime(F.lit("2024:02:31 00:00:00"))).alias("bad"))


@query("""
SELECT n_name, split_part(n_name || ', ' || r_name, ', ', 1) AS city, r_name AS state, CASE WHEN n_nationkey % 2 = 0 THEN 'Earth' END AS country FROM nation JOIN region ON n_regionkey = r_regionkey""")
def location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    written = F.concat(F.col("n_name"), F.lit(" , "), F.col("r_name"), F.when(F.col("n_nationkey") % 2 == 0, "/Earth").otherwise(""))
    place = location.place_from_text(written)
    return rows.select("n_name", place["city"].alias("city"), place["state"].alias("state"), place["country"].alias("country"))


@query("SELECT doc_id, nfc_normalize(text || 'e' || chr(769)) AS value FROM documents WHERE text IS NOT NULL")
def nfc_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in NFC, without the repair of misread texts; normalized_text has the repair too."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.select("doc_id", text.composed_text(F.concat("text", F.lit("e\u0301")))["value"].alias("value"))


@query()
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text, repaired and in NFC, and what was changed; no SQL says the repair."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.normalize_text("text").alias("t"))
    return docs.select("doc_id", F.col("t.value").alias("value"), F.col("t.changes").alias("changes"), F.col("t.fidelity_loss").alias("fidelity_loss"))


@query(r"""
WITH v AS (SELECT place_id, nfc_normalize(' ' || name || ': ?/x.  ') AS t FROM place_names)
SELECT place_id, trim(regexp_replace(regexp_replace(trim(t), '[<>:"/\\|?*]', '-', 'g'), '\s+', ' ', 'g'), ' .') AS part FROM v""")
def path_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "place_names").select("place_id", destinations.part(F.concat(F.lit(" "), F.col("name"), F.lit(": ?/x.  "))).alias("part"))


@query("SELECT place_id, trim(regexp_replace(lower(strip_accents(name)), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM place_names")
def event_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "place_names").select("place_id", text.slug("name").alias("slug"))


@query("""
SELECT c_custkey, round(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (c_custkey % 80 + (c_custkey % 60) / 60.0 + (c_custkey % 7) / 3600.0), 6) + 0.0 AS dms,
 round(CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE 1 END * (c_custkey % 80 + 30.0 / 60.0), 6) AS xmp, CASE WHEN c_custkey % 3 <> 0 THEN round(c_custkey / (c_custkey % 3), 6) ELSE -1.0 END AS quotient FROM customer""")
def dms_to_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    ref = F.when(k % 2 == 0, "S").otherwise("N")
    dms = gps.dms_to_decimal((k % 80).cast("double"), (k % 60).cast("double"), (k % 7).cast("double"), ref)
    xmp = gps.text_to_decimal(F.concat((k % 80).cast("string"), F.lit(",30.0"), ref))
    return table(spark, sf_dir, "customer").select("c_custkey", (F.round(dms, 6) + F.lit(0.0)).alias("dms"), F.round(xmp, 6).alias("xmp"), F.coalesce(F.round(gps.rational(k, k % 3), 6), F.lit(-1.0)).alias("quotient"))


@query(r"""
WITH f AS (SELECT op_id, any_value(source) AS source FROM file_operations GROUP BY op_id), n AS (SELECT op_id, regexp_extract(source, '([^/]*)/*$', 1) AS name FROM f)
SELECT op_id, regexp_extract(name, '^.+?(\.[^.]+)$', 1) AS suffix, regexp_replace(name, '^(.+?)(\.[^.]+)$', '\1') AS stem FROM n""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "source")
    return ops.select("op_id", paths.suffix(F.col("source")).alias("suffix"), paths.stem(F.col("source")).alias("stem"))


@query(r"""
WITH f AS (SELECT op_id, lower(any_value(source)) AS s FROM file_operations GROUP BY op_id), n AS (SELECT op_id, regexp_extract(s, '([^/]*)/*$', 1) AS n FROM f)
SELECT op_id, CASE WHEN regexp_matches(n, '_edit') THEN '*_edit*' WHEN regexp_matches(n, '-edit') THEN '*-edit*' WHEN regexp_matches(n, '_export') THEN '*_export*' WHEN regexp_matches(n, '-export') THEN '*-export*' WHEN regexp_matches(n, '_derivative') THEN '*_derivative*' WHEN regexp_matches(n, '-derivative') THEN '*-derivative*' WHEN regexp_matches(n, '_derived') THEN '*_derived*' WHEN regexp_matches(n, '-derived') THEN '*-derived*' END AS pattern FROM n""")
def derivative_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "source")
    name = paths.name(F.col("source"))
    return ops.select("op_id", text.first_glob([name, paths.stem(F.col("source"))], text.DERIVATIVE_GLOBS).alias("pattern"))


# ------------------------------------------------------------------ summaries


@query("""
WITH f AS (SELECT op_id, lower(regexp_extract(regexp_extract(any_value(source), '([^/]*)/*$', 1), '^.+?(\\.[^.]+)$', 1)) AS e FROM file_operations GROUP BY op_id)
SELECT CASE WHEN e = '' THEN '<none>' ELSE e END AS extension, count(*) AS n_files, CAST(sum(op_id) AS BIGINT) AS total_bytes FROM f GROUP BY 1""")
def format_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "source")
    return review.histogram(ops.select(paths.extension(F.col("source")).alias("extension"), F.col("op_id").alias("size")), "extension", "size")


@query("SELECT source, count(*) AS n_files FROM documents GROUP BY source ORDER BY n_files DESC, source LIMIT 8")
def format_top8(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"))
    return review.top_entries(counts, "source", "n_files")


def _ops(spark, sf_dir) -> DataFrame:
    ops = one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "date_fallback", "date_kind", "location_status", "coordinates", "camera_make", "camera_model", "location_id")
    return ops


_OPS_SQL = "WITH o AS (SELECT op_id, any_value(date_fallback) AS f, any_value(date_kind) AS k, any_value(location_status) AS s, any_value(coordinates) AS c, any_value(camera_make) AS m, any_value(location_id) AS l FROM file_operations GROUP BY op_id) "


@query(_OPS_SQL + """SELECT op_id, array_to_string(list_filter([CASE WHEN f OR k = 'inferred' THEN 'REVIEW_DATE' END, CASE WHEN s IN ('missing-gps', 'inferred', 'unknown-location', 'error', 'disabled') THEN 'REVIEW_LOCATION' END], lambda x: x IS NOT NULL), ';') AS flags FROM o""")
def review_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flags = review.review_flags(c("date_fallback"), c("date_kind"), F.lit(False), c("location_status"), F.lit(None).cast("string"))
    return _ops(spark, sf_dir).select("op_id", F.array_join(flags, ";").alias("flags"))


@query(_OPS_SQL + """, r AS (SELECT coalesce(f, false) OR coalesce(k = 'inferred', false) AS d, coalesce(s IN ('missing-gps', 'inferred', 'unknown-location', 'error', 'disabled'), false) AS p FROM o)
SELECT count(*) FILTER (d OR p) AS review_items, CAST(0 AS BIGINT) AS review_burst_items, CAST(0 AS BIGINT) AS review_conflict_items, count(*) FILTER (d) AS review_date_items, CAST(0 AS BIGINT) AS review_duplicate_items, count(*) FILTER (p) AS review_location_items FROM r""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    flags = review.review_flags(c("date_fallback"), c("date_kind"), F.lit(False), c("location_status"), F.lit(None).cast("string"))
    return review.review_summary(_ops(spark, sf_dir).select(flags.alias("review_flags")))


@query(_OPS_SQL + """SELECT 'plan' AS mode, CAST(0 AS BIGINT) AS processed_files, CAST(0 AS BIGINT) AS ignored_files, CAST(0 AS BIGINT) AS error_files, count(*) FILTER (f) AS fallback_files, count(l) AS location_files,
 count(c) AS gps_files, count(*) FILTER (s = 'missing-gps') AS missing_gps_files, count(*) FILTER (l IS NULL) AS organization_fallback_files FROM o""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ops(spark, sf_dir).withColumns({"location": F.col("location_id"), "organization_fallback": F.col("location_id").isNull()})
    return review.run_summary(rows, "plan")


@query(_OPS_SQL + """SELECT count(*) AS total, count(c) AS gps_files, count(*) FILTER (NOT coalesce(f, false)) AS timestamp_files, count(m) AS camera_files,
 CAST(round_even(100.0 * count(c) / count(*), 0) AS BIGINT) AS gps_percent, CAST(round_even(100.0 * count(*) FILTER (NOT coalesce(f, false)) / count(*), 0) AS BIGINT) AS timestamp_percent, CAST(round_even(100.0 * count(m) / count(*), 0) AS BIGINT) AS camera_percent FROM o""")
def health_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return review.health(_ops(spark, sf_dir), c("coordinates").isNotNull(), c("date_fallback"), c("camera_make").isNotNull())


@query("""SELECT config_id, CASE WHEN event_window_minutes * 1000 < 1024 THEN CAST(event_window_minutes * 1000 AS VARCHAR) || ' B' WHEN event_window_minutes * 1000 < 1048576 THEN printf('%.1f KB', event_window_minutes * 1000 / 1024.0) ELSE printf('%.1f MB', event_window_minutes * 1000 / 1048576.0) END AS size FROM organization_configs""")
def byte_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "organization_configs").select("config_id", text.byte_size(F.col("event_window_minutes") * 1000).alias("size"))


@query(_OPS_SQL + """, g AS (SELECT count(*) AS n FROM (SELECT 1 FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) HAVING count(*) > 1))
SELECT any_value(g.n) AS duplicate_groups, count(*) FILTER (coalesce(f, false)) AS conflict_operations, any_value(g.n) + count(*) FILTER (coalesce(f, false)) AS conflicts FROM o, g""")
def conflict_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups of documents and operations whose date is disputed (here: a fallback)."""
    hashed = _hashed_documents(spark, sf_dir)
    groups = hashed.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    plan = _ops(spark, sf_dir).select(F.array().cast("array<string>").alias("review_flags"), F.col("date_fallback").alias("date_conflict"))
    return review.conflict_total(groups, plan)


@query(r"""
WITH f AS (SELECT op_id, lower(regexp_extract(regexp_extract(any_value(source), '([^/]*)/*$', 1), '^.+?(\.[^.]+)$', 1)) AS e FROM file_operations GROUP BY op_id),
n AS (SELECT *, CASE WHEN e IN ('.jpg', '.jpeg') THEN 'JPEG' WHEN e = '.png' THEN 'PNG' WHEN e IN ('.tif', '.tiff') THEN 'TIFF' WHEN e = '.webp' THEN 'WEBP' WHEN e = '.bmp' THEN 'BMP' WHEN e IN ('.heic', '.heif', '.hif') THEN 'HEIF' ELSE '' END AS plain,
 CASE WHEN e = '.dng' THEN 'Apple ProRAW' WHEN e IN ('.cr2', '.cr3', '.crw') THEN 'Canon RAW' WHEN e = '.nef' THEN 'Nikon RAW' WHEN e = '.arw' THEN 'Sony RAW' WHEN e = '.rw2' THEN 'Panasonic RAW' WHEN e = '.orf' THEN 'Olympus/OM System RAW' WHEN e = '.raf' THEN 'Fujifilm RAW' ELSE '' END AS raw FROM f)
SELECT plain || raw AS format, raw AS raw_format, CASE WHEN e = '.dng' THEN 'Apple ProRAW / Linear DNG' ELSE '' END AS raw_flow, plain || raw <> '' AS supported, count(*) AS n_files FROM n GROUP BY 1, 2, 3, 4""")
def format_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format, RAW format and flow of every operation's extension, and whether it is supported."""
    ops = one_per_id(table(spark, sf_dir, "file_operations"), "op_id", "source")
    e = F.col("ext")
    looked = ops.select(paths.extension(F.col("source")).alias("ext")).select(paths.format_name(e).alias("format"), paths.raw_format(e).alias("raw_format"), paths.raw_flow(e).alias("raw_flow"), paths.is_supported(e).alias("supported"))
    return looked.groupBy("format", "raw_format", "raw_flow", "supported").agg(F.count(F.lit(1)).alias("n_files"))


@query("""
WITH l AS (SELECT location_id, any_value(city) AS c, any_value(state) AS s, any_value(country) AS k, any_value(latitude) AS lat, any_value(longitude) AS lon FROM reverse_geocoded_locations GROUP BY location_id),
t AS (SELECT *, concat_ws(', ', CASE WHEN location_id % 4 <> 0 THEN nullif(c, '') END, nullif(s, ''), CASE WHEN location_id % 4 <> 0 THEN nullif(k, '') END) AS place FROM l)
SELECT location_id, CASE WHEN place <> '' THEN place WHEN lat IS NOT NULL AND lon IS NOT NULL THEN CAST(round(lat) AS BIGINT) || ',' || CAST(round(lon) AS BIGINT) ELSE '' END AS place FROM t""")
def chosen_location(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as texts, every fourth without city and country; one without any name is told by its coordinates, here in whole degrees."""
    rows = one_per_id(table(spark, sf_dir, "reverse_geocoded_locations"), "location_id", "city", "state", "country", "latitude", "longitude")
    named = F.col("location_id") % 4 != 0
    place = F.struct(F.when(named, F.col("city")).alias("city"), "state", F.when(named, F.col("country")).alias("country"))
    whole = lambda c: F.round(c).cast("long").alias(c)
    at = F.when(F.col("latitude").isNotNull() & F.col("longitude").isNotNull(), F.struct(whole("latitude"), whole("longitude")))
    return rows.select("location_id", location.location_text(place, at).alias("place"))


@query("""
WITH p AS (SELECT prov_id, any_value(source) AS source, any_value(confidence) AS confidence, any_value(raw_value) AS v FROM metadata_provenance GROUP BY prov_id)
SELECT prov_id, CASE WHEN v IS NULL OR v = '' THEN 'missing' WHEN confidence = 'low' OR source IS NULL OR source NOT IN ('EXIF', 'XMP', 'IPTC-IIM', 'PNG metadata', 'Correction manifest') THEN 'inferred-or-fallback' ELSE 'real-metadata' END AS evidence FROM p""")
def date_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How good the evidence of each provenance row is; low confidence stands for a fallback."""
    rows = one_per_id(table(spark, sf_dir, "metadata_provenance"), "prov_id", "source", "confidence", "raw_value")
    status = F.when(F.coalesce("raw_value", F.lit("")) != "", "resolved").otherwise("missing")
    return rows.select("prov_id", review.date_evidence(status, F.col("source"), F.col("confidence") == "low").alias("evidence"))


@query(_OPS_SQL + """SELECT op_id, CASE WHEN s IN ('resolved', 'gps') AND c.latitude IS NOT NULL THEN 'real-gps' WHEN s = 'inferred' THEN 'inferred' WHEN s IN ('missing', 'missing-gps') OR s IS NULL THEN 'missing' ELSE s END AS evidence FROM o""")
def location_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("location_status")
    return _ops(spark, sf_dir).select("op_id", review.location_evidence(status, F.lit(None).cast("string"), F.col("coordinates.latitude")).alias("evidence"))


@query("""
WITH j AS (SELECT entry_id, any_value(status) AS status, any_value(action) AS action, any_value(source) AS source, any_value(destination) AS destination, any_value(error) AS error FROM journal_entries GROUP BY entry_id),
p AS (SELECT *, source || coalesce(' -> ' || nullif(destination, ''), '') AS path FROM j), a AS (SELECT *, strpos(path, ' -> ') AS arrow FROM p)
SELECT entry_id, CASE WHEN action IS NULL OR path IS NULL THEN NULL WHEN status = 'error' THEN 'error' WHEN status = 'skipped' THEN 'skipped' ELSE 'success' END AS status,
 CASE WHEN path IS NOT NULL THEN action END AS action, CASE WHEN action IS NULL THEN NULL WHEN arrow > 0 THEN left(path, arrow - 1) ELSE path END AS source,
 CASE WHEN action IS NULL OR path IS NULL THEN NULL WHEN arrow > 0 THEN substr(path, arrow + 4) ELSE '' END AS destination,
 CASE WHEN action IS NULL OR path IS NULL THEN NULL WHEN status = 'error' THEN coalesce(error, '') WHEN status = 'skipped' THEN 'conflict: destination exists' ELSE '' END AS observations FROM a""")
def log_lines_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every journal entry written as a run's log line and read back; an entry without action or source has no line."""
    rows = one_per_id(table(spark, sf_dir, "journal_entries"), "entry_id", "status", "action", "source", "destination", "error")
    level = F.when(F.col("status") == "error", "ERROR").when(F.col("status") == "skipped", "SKIP").otherwise("INFO")
    notes = F.when(F.col("status") == "error", F.concat(F.lit(" (error: "), F.coalesce("error", F.lit("")), F.lit(")"))).when(F.col("status") == "skipped", " (conflict: destination exists)").otherwise("")
    to = F.coalesce(F.concat(F.lit(" -> "), F.nullif("destination", F.lit(""))), F.lit(""))
    read = review.outcome_of_log(F.concat(F.lit("["), level, F.lit("] "), F.col("action"), F.lit(" "), F.col("source"), to, notes))
    return rows.select("entry_id", *[read[k].alias(k) for k in ("status", "action", "source", "destination", "observations")])
