"""Sessions, timestamps and spatial joins against brute force; nulls, ties, repeats, empty tables, clashing names."""

import math
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fotostrata.operators.sessions import bitmap_runs, close_bitmap, gap_sessions
from fotostrata.operators.spatial import PackedTree, block_tasks, haversine_m, in_area, inside_areas, near_links, near_pairs, parse_wkt, plan_quadtree, tree_join
from fotostrata.operators.timestamps import to_utc

# ---------------------------------------------------------------- sessions


@given(st.sets(st.integers(0, 300), min_size=1, max_size=40), st.integers(0, 40))
def test_closing_joins_exactly_what_a_chain_of_steps_joins(bits, reach):
    runs = bitmap_runs(close_bitmap(sum(1 << b for b in bits), reach))
    want, ordered = [], sorted(bits)
    for b in ordered:
        if want and b - want[-1][1] <= reach + 1:
            want[-1][1] = b
        else:
            want.append([b, b])
    assert [list(r) for r in runs] == want


def brute_sessions(rows):
    out = []
    by = {}
    for e, at, gap in rows:
        if e is not None and at is not None and gap is not None:
            by.setdefault(e, []).append((at, gap))
    for e, events in by.items():
        current = None
        for at, gap in sorted(events):
            if current and at - current[2] <= max(0, gap):
                current[2], current[3] = at, current[3] + 1
            else:
                current = [e, at, at, 1]
                out.append(current)
    return sorted((e, a, b, b - a, n) for e, a, b, n in out)


def run_sessions(spark, rows, least):
    df = spark.createDataFrame(rows, "who string, at long, gap long").withColumns({"bit": F.lit(1), "n": F.lit("x"), "entity": F.lit(2)})
    return sorted(tuple(r) for r in gap_sessions(df, "who", "at", "gap", least).collect())


def test_sessions_match_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(f"c{rng.integers(4)}", int(x), 1_000_000) for x in np.cumsum(rng.choice([1, 999_999, 1_000_000, 1_000_001, 30_000_000, 900_000_000], 3000)) - 2_000_000_000]
    rows += [(None, 5, 10**6), ("c0", None, 10**6), ("c0", 5, None)] + rows[:50]
    assert run_sessions(spark, rows, 1_000_000) == brute_sessions(rows)


def test_sessions_with_several_gaps_and_edge_cases(spark):
    rng = np.random.default_rng(4)
    rows = [("a", int(t), int(g)) for t, g in zip(np.cumsum(rng.integers(0, 2_000_000, 2000)), rng.choice([500_000, 1_000_000, 1_700_000], 2000), strict=True)]
    # equal times with different gaps are ordered by gap in both
    assert run_sessions(spark, rows, 500_000) == brute_sessions(rows)
    assert run_sessions(spark, [("a", 1, 0), ("a", 1, 0), ("a", 2, 0)], 0) == [("a", 1, 1, 0, 2), ("a", 2, 2, 0, 1)]
    assert run_sessions(spark, [], 10) == []
    with pytest.raises(Exception, match="gap below"):
        run_sessions(spark, [("a", 1, 5)], 10)


# ---------------------------------------------------------------- timestamps


def utc(spark, rows):
    df = spark.createDataFrame(rows, "v string, z string, c string").withColumns({"utc": F.lit(1), "_row": F.lit(2), "zone_id": F.lit("x")})
    return [r.utc_us for r in to_utc(df, "v", "z", "c").collect()]


def us(*a, zone=timezone.utc):
    return int((datetime(*a, tzinfo=zone) - datetime(1970, 1, 1, tzinfo=timezone.utc)) / timedelta(microseconds=1))


CASES = [
    ("2016:02:01 23:36:55", "Europe/Berlin", "+1h", us(2016, 2, 2, 0, 36, 55, zone=ZoneInfo("Europe/Berlin"))),
    ("2016-02-01T23:36", "+05:45", None, us(2016, 2, 1, 17, 51)),
    ('["2011:06:08 00:22:20+0200"]', None, None, us(2011, 6, 7, 22, 22, 20)),
    ('["2011:06:08 00:22:20\\u221202:00"]', None, None, us(2011, 6, 8, 2, 22, 20)),
    ("Thu, 17 Oct 2013 04:24:13", " america/new york ", None, us(2013, 10, 17, 8, 24, 13)),
    ("2008/01/17 12:49:37 PMz", None, None, us(2008, 1, 17, 12, 49, 37)),
    ("2008/01/17 12:49:37 AM", "UTC", "fast", us(2008, 1, 17, 0, 49, 37)),
    ("September 13, 2009 5:44:58 p.m.−05:00", None, "-1d", us(2009, 9, 12, 22, 44, 58)),
    ("7 Oct 2013, 14:09:31 GMT+11:00", "Moon/Base", None, us(2013, 10, 7, 3, 9, 31)),
    ("13.06.2015 19:16", "UTC+5:45", " 1:15 ", us(2015, 6, 13, 14, 46)),
    ("1209557983", "Asia/Tokyo", None, 1209557983000000),
    ("1441932244580", None, "+0001", 1441932304580000),
    ("20090118T023009+05", None, None, us(2009, 1, 17, 21, 30, 9)),
    ("2013-11-07 15:57:50,506123999 UTC+5:45", None, None, us(2013, 11, 7, 10, 12, 50, 506123)),
    ("2012-10-28 02:30:00", "Europe/Berlin", None, us(2012, 10, 28, 0, 30)),  # occurs twice: the first
    ("2012-03-25 02:30:00", "Europe/Berlin", None, us(2012, 3, 25, 1, 30)),  # skipped: the offset before
    *[(v, "UTC", None, None) for v in (None, "", " ", "2016-02-30 10:00:00", "2016-09-04", "2016-07-02T23:", "24:00:00", "2016-01-01 24:00:00", "unknown", "0000:00:00 00:00:00", "x" * 100_000)],
    *[("2016-02-01 23:36:55", z, None, None) for z in (None, "", "Moon/Base", "+99:00", "summer", "?")],
]


def test_timestamps(spark):
    got = utc(spark, [c[:3] for c in CASES])
    assert got == [c[3] for c in CASES]
    assert utc(spark, []) == []


# ---------------------------------------------------------------- spatial


def brute_near(rows, within):
    good = [r for r in rows if None not in r and abs(r[1]) <= 90 and abs(r[2]) <= 180 and (r[1], r[2]) != (0, 0)]
    out = set()
    for i, a in enumerate(good):
        for b in good[i + 1 :]:
            if a[3] != b[3] and a[0] != b[0] and haversine_m(a[1], a[2], b[1], b[2]) <= within:
                out.add((min(a[0], b[0]), max(a[0], b[0])))
    return out


def near(spark, rows, within=60.0, **options):
    df = spark.createDataFrame(rows, "id long, lat double, lon double, owner string").withColumns({"leaf": F.lit(1), "task": F.lit("x"), "home": F.lit(0)})
    got = [tuple(r) for r in near_pairs(df, within, **options).collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.fixture(scope="module")
def places():
    rng = np.random.default_rng(8)
    hubs = [(10.0, 20.0), (-46.2, 179.99999), (-46.2, -179.99999), (89.9999, 5.0), (-89.9999, -100.0), (84.9998, 30.0), (85.0002, 30.0), (0.0, 0.0001)]
    rows = []
    for k in range(900):
        lat, lon = hubs[k % len(hubs)] if k % 3 else hubs[0]
        lat, lon = lat + rng.normal() * 3e-4, (lon + rng.normal() * 4e-4 + 180) % 360 - 180
        rows.append((k, min(90.0, max(-90.0, lat)), lon, f"cam{0 if k % 3 == 0 else k % 7}"))
    rows += [(5000, None, 1.0, "a"), (5001, 0.0, 0.0, "a"), (5002, 95.0, 1.0, "a"), (5003, 10.0, 20.0, None), (None, 10.0, 20.0, "a"), (5004, 10.0, None, "a")]
    return rows


@pytest.mark.parametrize("per_leaf", [5000, 40, 7])
def test_near_matches_brute_force(spark, places, per_leaf):
    assert near(spark, places, per_leaf=per_leaf) == brute_near(places, 60.0)


@pytest.mark.parametrize(("heavy", "heavy_blocks", "other_blocks"), [(0.0, 0, 7), (0.6, 5, 3), (1.0, 4, 1)])
def test_blocks_of_a_crowded_leaf_meet_once(heavy, heavy_blocks, other_blocks):
    ids, is_heavy = np.arange(400) * 3 + 1, np.random.default_rng(2).random(400) < heavy
    who, task, side = block_tasks(ids, is_heavy, heavy_blocks, other_blocks)
    assert np.bincount(who, minlength=400).max() <= heavy_blocks + other_blocks
    met = np.zeros((400, 400), int)
    for t in np.unique(task):
        rows, sides = who[task == t], side[task == t]
        one_block = t // (1 << 20) == t % (1 << 20)
        cross = np.ones((len(rows), len(rows)), int) if one_block else (sides[:, None] != sides[None]).astype(int)
        met[np.ix_(rows, rows)] += cross
    wanted = ~(is_heavy[:, None] & is_heavy[None])
    assert (met[wanted & ~np.eye(400, dtype=bool)] == 1).all() and (met[is_heavy][:, is_heavy] == 0).all()


def test_a_hundred_thousand_captures_on_one_spot(spark):
    df = spark.range(100_000).select("id", F.lit(10.0).alias("lat"), F.lit(20.0).alias("lon"), F.concat(F.lit("cam"), F.col("id") % 50).alias("owner"))
    other = spark.createDataFrame([(200_000, 10.0001, 20.0, "cam7"), (200_001, 12.0, 20.0, "cam7"), (200_002, None, 1.0, "x"), (200_003, 0.0, 0.0, "x")], "id long, lat double, lon double, owner string")
    links = near_links(df.union(other), 60.0, per_leaf=10)
    got = links.groupBy("class_id", "n_links").agg(F.count("id").alias("n")).collect()
    assert {(r.class_id, r.n_links, r.n) for r in got} == {*((k, 98_000 if k == 7 else 98_001, 2000) for k in range(50)), (200_000, 98_000, 1), (200_001, 0, 1)}


def test_near_edge_cases(spark):
    assert near(spark, []) == set()
    same = [(i, 10.0, 20.0, "one") for i in range(500)] + [(1000, 10.0, 20.0, "two")]
    assert near(spark, same, per_leaf=50) == {(i, 1000) for i in range(500)}


def test_tree_join_matches_all_pairs():
    rng = np.random.default_rng(1)
    a, b = rng.random((300, 2)), rng.random((170, 2))
    got = {(i, j) for x, y in tree_join(PackedTree(a, a + 0.03), PackedTree(b, b + 0.05), chunk=500) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    want = {(i, j) for i in range(300) for j in range(170) if (a[i] <= b[j] + 0.05).all() and (b[j] <= a[i] + 0.03).all()}
    assert got == want


@settings(max_examples=40)
@given(st.lists(st.tuples(st.floats(-90, 90), st.floats(-180, 180)), min_size=1, max_size=60))
def test_every_point_near_a_point_shares_its_home_leaf(points):
    reach = math.degrees(60 / 6_371_000)
    tree = plan_quadtree([(a, o, "c") for a, o in points], 60, 1, reach)
    lat, lon = np.array([p[0] for p in points]), np.array([p[1] for p in points])
    home = tree.leaf_of(lat, lon)
    who, leaf = tree.touched(lat, lon, reach)
    reached = set(zip(who.tolist(), leaf.tolist(), strict=True))
    for i in range(len(points)):
        for j in np.flatnonzero(haversine_m(lat[i], lon[i], lat, lon) <= 60):
            assert (int(j), int(home[i])) in reached


SQUARE = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
MULTI = "MULTIPOLYGON (((20 20, 30 20, 25 30, 20 20)), ((-10 -10, -5 -10, -5 -5, -10 -5, -10 -10)))"


@pytest.mark.parametrize("per_leaf", [1000, 10])
def test_inside_matches_brute_force(spark, per_leaf):
    rng = np.random.default_rng(2)
    points = [(i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-15, 35, 600), rng.uniform(-15, 35, 600), strict=True))]
    areas = [(1, SQUARE), (2, MULTI), (3, "POLYGON ((1 1, 3 1, 3 3, 1 3, 1 1))"), (4, "POINT (1 1)"), (5, None), (6, "POLYGON ((broken"), (None, SQUARE)]
    shapes = {k: parse_wkt(w) for k, w in areas[:3]}
    want = {(i, k) for i, a, o in points for k, s in shapes.items() if in_area(np.array([o]), np.array([a]), s)[0]}
    df = spark.createDataFrame([*points, (9000, None, 2.0), (9001, 100.0, 2.0)], "id long, lat double, lon double").withColumn("wkt", F.lit("x"))
    shapes_df = spark.createDataFrame(areas, "area_id long, wkt string").withColumn("leaf", F.lit(3))
    got = [tuple(r) for r in inside_areas(df, shapes_df, per_leaf=per_leaf).collect()]
    assert set(got) == want and len(got) == len(want)
    assert inside_areas(df, shapes_df.limit(0)).count() == 0 and inside_areas(df.limit(0), shapes_df).count() == 0
