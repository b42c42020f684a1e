"""Reference operators on small fixtures: naming, reconciliation, events, bursts, rules, places, review, streaming."""

import itertools
import os
import random
from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fotostrata.functions import dates, gps, paths, text
from fotostrata.operators import destinations, events, location, lookup, naming, reconcile, review, rules
from fotostrata.streaming.sessions import stream_sessions


def greedy(rows, taken):
    taken, out = set(taken), {}
    for source, wanted in sorted(rows):
        for k in itertools.count():
            name = naming._numbered(wanted, k)
            if name not in taken:
                break
        taken.add(name)
        out[source] = name
    return out


NAMES = st.sampled_from(["a.jpg", "a_01.jpg", "a_02.jpg", "a_01_01.jpg", "b.jpg", "a.png", "a"])


@settings(max_examples=60)
@given(st.lists(NAMES, max_size=14), st.sets(NAMES, max_size=4))
def test_family_naming_is_the_greedy_one(wanted, taken):
    rows = [(f"s{i:02d}", n) for i, n in enumerate(wanted)]
    got = dict(naming.resolve_family([(s, n, []) for s, n in rows], set(taken), "suffix"))
    assert got == greedy(rows, taken)


def test_destinations(spark):
    rows = [("s1", "o/a.jpg"), ("s2", "o/a.jpg"), ("s3", "o/a_01.jpg"), ("s4", "p/a.jpg"), ("s5", "o/b.jpg"), ("s6", "o/b.jpg"), ("s7", "x.jpg"), ("s8", "x.jpg"), (None, "o/q.jpg"), ("s9", None)]
    plan = spark.createDataFrame(rows, "source string, destination string").withColumn("folder", F.lit("clash"))
    got = {r.source: r.final_destination for r in naming.resolve_destinations(plan).collect()}
    assert got == {"s1": "o/a.jpg", "s2": "o/a_01.jpg", "s3": "o/a_01_01.jpg", "s4": "p/a.jpg", "s5": "o/b.jpg", "s6": "o/b_01.jpg", "s7": "x.jpg", "s8": "x_01.jpg"}
    there = spark.createDataFrame([("o/a.jpg",), ("o/b_01.jpg",)], "path string")
    got = {r.source: r.final_destination for r in naming.resolve_destinations(plan, there).collect()}
    assert (got["s1"], got["s2"], got["s3"], got["s5"], got["s6"]) == ("o/a_01.jpg", "o/a_02.jpg", "o/a_01_01.jpg", "o/b.jpg", "o/b_02.jpg")
    skipped = {r.source: r.final_destination for r in naming.resolve_destinations(plan, there, "skip").collect()}
    assert skipped["s1"] is None and skipped["s5"] == "o/b.jpg" and skipped["s6"] is None
    with pytest.raises(naming.DestinationConflict):
        naming.resolve_destinations(plan, policy="fail-fast")
    assert naming.resolve_destinations(plan.limit(0), there).count() == 0


@pytest.mark.parametrize("policy", ["suffix", "skip"])
@pytest.mark.parametrize("existing", [True, False])
def test_families_are_resolved_in_one_stream(spark, policy, existing):
    rng = random.Random(7)
    names = [f"{rng.choice('abc')}{rng.choice(['', '_01', '_02'])}.{rng.choice(['jpg', 'cr2', 'xmp'])}" for _ in range(400)]
    rows = [(f"/in/{k:04d}.x", f"/out/{k % 60}/{name}", [f"/in/{k:04d}.xmp"] if name.endswith("cr2") else []) for k, name in enumerate(names)]
    there = [(f"/out/{k}/{rng.choice('abc')}.jpg",) for k in range(0, 80, 3)] if existing else []
    plan = spark.createDataFrame(rows, "source string, destination string, related_sidecars array<string>").repartition(5)
    got = naming.resolve_destinations(plan, spark.createDataFrame(there, "path string") if existing else None, policy, sidecars="related_sidecars")
    expected = {}
    for folder in {os.path.dirname(d) for _, d, _ in rows}:
        taken = {os.path.basename(p) for (p,) in there if os.path.dirname(p) == folder}
        here = [(s, os.path.basename(d), [".xmp"] * len(x)) for s, d, x in rows if os.path.dirname(d) == folder]
        expected |= {s: n and f"{folder}/{n}" for s, n in naming.resolve_family(here, taken, policy)}
    assert {r.source: r.final_destination for r in got.collect()} == expected
    # a pandas frame for every family takes milliseconds each
    assert "FlatMap" not in got._jdf.queryExecution().toString()


def test_reconcile(spark):
    day = lambda d: datetime(2024, 1, d)
    schema = "path string, seq int, value timestamp_ntz, source string, field string, confidence string, raw_value string, role string, precedence int, used_fallback boolean, date_kind string"
    row = lambda p, i, v, s, r: (p, i, v, s, "f", "high", None, "primary", r, False, "captured")
    df = spark.createDataFrame([row("a", 0, day(5), "EXIF", 0), row("a", 1, day(3), "XMP", 2), row("a", 2, day(9), "XMP", 2), row("a", 3, day(9), "filesystem", 9), row("b", 0, day(1), "EXIF", 1), row("b", 1, day(1), "XMP", 1)], schema)
    got = lambda p: {r.path: r for r in reconcile.reconcile(df, p).collect()}
    assert got("precedence")["a"].selected.value == day(5) and got("precedence")["a"].conflict and not got("precedence")["b"].conflict
    assert got("newest")["a"].selected.source == "XMP" and got("oldest")["a"].selected.value == day(3)
    assert got("filesystem")["a"].selected.source == "filesystem" and "unavailable" in got("filesystem")["b"].reason
    assert got("precedence")["b"].selected.source == "EXIF" and [c.source for c in got("precedence")["a"].candidates] == ["EXIF", "XMP", "XMP", "filesystem"]
    with pytest.raises(ValueError):
        reconcile.reconcile(df, "odd")


def shots(spark, *minutes, step=60):
    base = datetime(2024, 8, 15, 10)
    rows = [(f"IMG_{1001 + i}.jpg", base + timedelta(seconds=m * step)) for i, m in enumerate(minutes)]
    return spark.createDataFrame([*rows, ("none.jpg", None)], "source string, chosen_date timestamp_ntz").withColumn("stem", F.regexp_replace("source", r"\.jpg$", ""))


@pytest.mark.parametrize("entity", [None, "who"])
def test_events_and_equal_gaps(spark, entity):
    df = shots(spark, 0, 20, 60, 90).withColumn("who", F.lit("x"))
    got = {r.source: r for r in events.event_columns(events.gap_groups(df, "chosen_date", 30 * 60_000_000, "source", entity), 30).collect()}
    assert [got[f"IMG_{k}.jpg"].event_id for k in (1001, 1002, 1003, 1004)] == ["event-001", "event-001", "event-002", "event-002"]
    assert got["none.jpg"].event_id is None and got["IMG_1001.jpg"].event_label == "event-001_2024-08-15_10-00" and got["IMG_1003.jpg"].event_start == datetime(2024, 8, 15, 11)
    with pytest.raises(ValueError):
        events.gap_groups(df, "chosen_date", 0, "source")


def test_bursts(spark):
    df = shots(spark, 0, 1, 2, 50, 51, step=1)
    plain = {r.source: r for r in events.mark_bursts(df, "chosen_date", "source", 2).collect()}
    assert plain["IMG_1002.jpg"].burst_mark == "REVIEW_BURST" and plain["IMG_1002.jpg"].burst_group_size == 3 and plain["IMG_1004.jpg"].burst_mark is None
    close = {r.source: r for r in events.mark_bursts(df, "chosen_date", "source", 2, similarity=0.8).collect()}
    assert close["IMG_1001.jpg"].burst_mark == "BURST" and close["IMG_1001.jpg"].burst_reason == "temporal gap <= 2s; filename similarity 0.88 >= 0.80"


def test_event_names(spark):
    at = datetime(2024, 8, 15, 10)
    schema = "event_id string, group_index long, chosen_date timestamp_ntz, source string, folder string, city string, state string, country string, correction_event string"
    rows = [("event-001", 1, at, "a", "beach", None, None, None, None), ("event-001", 1, at, "b", "beach", "", "São Paulo", None, None), ("event-002", 2, at, "c", "x", None, None, None, "Ano Novo!"), ("event-003", 3, at, "d", "z", None, None, None, None),
            ("event-003", 3, at, "e", "y", None, None, None, None), ("event-004", 4, at, "f", "", None, None, None, None)]
    got = {r.event_id: r.event_name for r in events.event_names(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"event-001": "2024-08-15-sao-paulo", "event-002": "ano-novo", "event-003": "2024-08-15-y", "event-004": "evento-004"}


def test_rules(spark):
    files = spark.createDataFrame([("old/a.jpg", "a.jpg", "Canon", "EOS  R5"), ("new/b.jpg", "b.jpg", None, None)], "relative string, name string, make string, model string")
    given_rules = [rules.Rule("glob", "old/*.jpg", city="Paraty", state="RJ"), rules.Rule("file", "old/a.jpg", date="1969-07-20T20:17:00", city="Rio"), rules.Rule("camera", "Canon EOS R5", camera_make="canon", camera_model="eos r*", timezone="UTC", priority="heuristic")]
    got = {r.name: r.correction for r in rules.apply_rules(files, given_rules).collect()}
    assert got["a.jpg"].city == "Rio" and got["a.jpg"].state == "RJ" and got["a.jpg"].timezone == "UTC" and got["a.jpg"].priority == "heuristic" and len(got["a.jpg"].selectors) == 3
    assert got["b.jpg"] is None and rules.apply_rules(files, []).where("correction is not null").count() == 0


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_texts_dates_and_coordinates(spark):
    lit = F.lit
    got = one(spark, text.normalize_text(lit("SÃ£o Paulo"))["value"], text.path_part(lit(' a<b: c.. '))["value"], text.path_part(lit(" . "), "X")["changes"], text.describe_change("city", text.path_part(lit("a/b"))))
    assert list(got) == ["São Paulo", "a-b- c", ["trimmed or collapsed whitespace", "used default for empty text"], "city: replaced invalid path characters; fidelity loss"]
    assert text.clean_text("caf\xe9".encode("cp1252")) == ("café", "café", ["decoded bytes as cp1252"], False)
    assert list(one(spark, text.byte_size(lit(1023)), text.byte_size(lit(1536)), text.byte_size(lit(5 * 1024**4)))) == ["1023 B", "1.5 KB", "5.0 TB"]
    assert list(one(spark, lit("photo.jpg").rlike(text.glob_regex("p?oto.[jp]*")), lit("a/b.jpg").rlike(text.glob_regex("*.jpg")), lit("a").rlike(text.glob_regex("[!a]")))) == [True, True, False]
    assert list(one(spark, dates.name_date(lit("IMG_20240815-143209"))["value"], dates.name_date(lit("x20241399"))["value"], dates.name_date(lit("2024-08-15"))["matched"])) == [datetime(2024, 8, 15, 14, 32, 9), None, "2024-08-15"]
    assert list(one(spark, dates.exif_datetime(lit("2024:1:2 3:4:5")), dates.exif_datetime(lit("2024-01-02T03:04:05+02:00")), dates.exif_datetime(lit("junk")))) == [datetime(2024, 1, 2, 3, 4, 5), datetime(2024, 1, 2, 3, 4, 5), None]
    assert list(one(spark, gps.text_to_decimal(lit("48,30.0N")), gps.text_to_decimal(lit("46 37 30 w")), gps.text_to_decimal(lit("-23.5")), gps.text_to_decimal(lit("x")))) == [48.5, -46.625, -23.5, None]
    assert list(one(spark, paths.suffix(lit("/a.b/.hidden")), paths.stem(lit("/a/b.tar.gz")), paths.parent(lit("/a/b.c")), paths.raw_flow(lit(".dng")))) == ["", "b.tar", "/a", "Apple ProRAW / Linear DNG"]


def test_places(spark):
    def place(t):
        return one(spark, location.place_from_text(F.lit(t)))[0]

    assert tuple(place("Paraty, RJ / Brasil")) == ("Paraty", "RJ", "Brasil") and tuple(place("Rio-RJ")) == ("Rio", "RJ", None)
    assert place("2024-08-15") is None and place("tmp, x") is None and place("a, 12") is None and place(" ") is None
    assert one(spark, location.folder_place(F.lit("Paraty, RJ/2024/img.jpg")))[0].city == "Paraty"


def test_patterns(spark):
    for bad, allowed in (("{nope}", {"date"}), ("{date.x[0]}{who}", {"date"})):
        with pytest.raises(ValueError):
            destinations.check_pattern(bad, allowed)
    with pytest.raises(ValueError):
        destinations.pattern_name("a/{stem}", F.lit(""), F.lit(""), F.lit(""), F.lit(""))
    at = F.lit(datetime(2024, 8, 15, 9)).cast("timestamp_ntz")
    got = one(spark, destinations.render("{date:%Y-%m}_{index:03d}", {"date": at, "index": F.lit(7)}), destinations.pattern_folder(F.lit("o"), at, "{date:%Y}//{city}", F.lit(None), F.lit(None), F.lit("Rio")))
    assert list(got) == ["2024-08_007", "o/2024/Rio"]


def test_review(spark):
    flags = review.review_flags(F.lit(True), F.lit(None), F.lit(None), F.lit("disabled"), F.lit("REVIEW_BURST"), F.lit("skipped"), F.lit("Destination CONFLICT"), F.lit(True))
    row = one(spark, flags.alias("f"))
    assert row.f == list(review.FLAGS)
    got = one(spark, review.review_suggestions(flags), review.review_reasons(flags, F.lit(None), F.lit(""), F.lit(None), F.lit("x conflict")))
    assert got[0].count("; ") == 4 and "REVIEW_CONFLICT: x conflict" in got[1] and "location status is unknown" in got[1]
    assert review.health(spark.range(0), F.lit(True), F.lit(False), F.lit(True)).first().gps_percent is None


@pytest.mark.parametrize("line, want", [
    ("[ERROR] COPY /a/IMG (1).jpg -> /b/x.jpg (error: disk full)", ("error", "COPY", "/a/IMG (1).jpg", "/b/x.jpg", "disk full")),
    ("[ERROR] MOVE /a (error: 1)/b.jpg -> /b/b.jpg (error: no (more) room)", ("error", "MOVE", "/a (error: 1)/b.jpg", "/b/b.jpg", "no (more) room")),
    ("[SKIP] MOVE /a/b (2).jpg -> /c/b (2).jpg (conflict: destination exists)", ("skipped", "MOVE", "/a/b (2).jpg", "/c/b (2).jpg", "conflict: destination exists")),
    ("[INFO] COPY /a/IMG (1) -> /b/IMG (1)", ("success", "COPY", "/a/IMG (1)", "/b/IMG (1)", "")),
    ("[INFO] COPY  /a/IMG (1).jpg (note 5)", ("success", "COPY", " /a/IMG (1).jpg", "", "note 5")),
    ("[DRY-RUN] COPY /a -> /b", ("dry-run", "COPY", "/a", "/b", "simulated; no filesystem changes applied")),
    ("[STAGED] COPY /a\n(1) -> /b", ("staged", "COPY", "/a\n(1)", "/b", "")),
    # undefined: the source holds the arrow, and ends at its first
    ("[INFO] COPY /a -> b.jpg -> /c/d.jpg", ("success", "COPY", "/a", "b.jpg -> /c/d.jpg", "")),
    ("no line of a log", None),
])
def test_log_lines(spark, line, want):
    got = one(spark, review.outcome_of_log(F.lit(line)).alias("o")).o
    assert (got and tuple(got)) == want


def test_skewed_lookup(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id long, k string")
    keyed = spark.createDataFrame([("hot", 200, "H"), ("k0", 1, "zero"), ("k3", 1, "three"), ("gone", 1, "x")], "k string, n long, v string")
    got = sorted((r.id, r.v) for r in lookup.skewed_lookup(rows, keyed, ["k"], "n", hot_keys=1).collect())
    assert len(got) == 202 and got[0] == (0, "zero") and (1, "H") in got and (3, "three") in got


def test_streaming_sessions(spark, tmp_path):
    rows = [("c", datetime(2024, 1, 1, 10, m)) for m in (0, 10, 20, 45)] + [("c", datetime(2024, 1, 2))]
    spark.createDataFrame(rows, "camera string, at timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("camera string, at timestamp").parquet(str(tmp_path / "in"))
    query = stream_sessions(stream, "camera", "at", "10 minutes").writeStream.format("memory").queryName("sessions_out").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = sorted((r.start, r.n_events) for r in spark.table("sessions_out").collect())
    assert got[:2] == [(datetime(2024, 1, 1, 10), 3), (datetime(2024, 1, 1, 10, 45), 1)]


def test_a_table_of_rules_says_what_a_list_says(spark):
    from fotostrata.operators.rules import FIELDS, Rule, apply_rule_table, apply_rules

    listed = [
        Rule("glob", "*.jpg", city="A", event="e1"), Rule("folder", "x/y/", city="B"), Rule("folder", ".", country="Z"), Rule("file", "b.png", state="S", priority="heuristic"), Rule("path", "x/a.jpg", city="C"),
        Rule("camera", "canon*", event="cam"), Rule("camera_profile", None, camera_make=" CANON ", camera_model="EOS  ?", timezone="UTC"), Rule("camera_model", "R5*", city="M"), Rule("camera_make", "Nikon", date="2020-01-01", priority="metadata"),
        Rule("glob", "[ab].*", clock_offset="+1h"), Rule("pattern", "*", state="T"), Rule("glob", "", city="never"),
    ]
    files = [(1, "x/a.jpg", "a.jpg", "Canon", "EOS R"), (2, "x/y/b.png", "b.png", None, None), (3, "c.tif", "c.tif", "nikon", "R5 II"), (4, "x/y/z/d.jpg", "d.jpg", " ", ""), (5, None, None, "Canon", None)]
    df = spark.createDataFrame(files, "id long, relative string, name string, make string, model string").withColumns({"channel": F.lit(1), "key": F.lit("x"), "labels": F.lit(2)})
    names = ["selector_type", "selector", "camera_make", "camera_model", *FIELDS, "priority"]
    rows = [(i, *(getattr(r, n) for n in names)) for i, r in enumerate(listed)]
    table = spark.createDataFrame([*rows, rows[0], (99, "planet", *[None] * (len(names) - 1)), (None, "folder", "", *[None] * (len(names) - 2))], "rule_id long, " + ", ".join(f"{n} string" for n in names))
    want = {r.id: r.correction for r in apply_rules(df, listed).collect()}
    got = {r.id: r.correction for r in apply_rule_table(df, table, "id").collect()}
    assert got.keys() == want.keys()
    for i in got:
        a, b = got[i].asDict(), want[i].asDict()
        a["selectors"], b["selectors"] = sorted(a["selectors"]), sorted(b["selectors"])
        assert a == b, i
    assert apply_rule_table(df, table.limit(0), "id").where("correction is not null").count() == 0 and apply_rule_table(df.limit(0), table, "id").count() == 0


def test_parts_of_odd_paths(spark):
    odd = {"/a/b/c.jpg": ("/a/b", "c.jpg"), "/a//b": ("/a", "b"), "//a": ("", "a"), "a/": ("a", "a"), "/a/b//": ("/a", "b"), "x": ("", "x"), "": ("", ""), "/": ("", ""), "/a\nb/c.jpg": ("/a\nb", "c.jpg")}
    df = spark.createDataFrame([(p,) for p in odd], "p string")
    assert {r.p: (r.parent, r.name) for r in df.select("p", paths.parent(F.col("p")).alias("parent"), paths.name(F.col("p")).alias("name")).collect()} == odd
