"""Every query with SQL gives what the SQL gives, on the smallest tables."""

import os
import threading
import unicodedata

import duckdb
import pytest

import __spark_entry__ as entry
from fotostrata import queries_general, queries_media, queries_reference, session

TABLES = os.environ.get("FOTOSTRATA_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")


@pytest.fixture(scope="module")
def sql():
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for file in os.listdir(TABLES):
        connection.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{TABLES}/{file}'")
    return connection


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(r[i] for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", [*queries_reference.ORACLES, *queries_general.ORACLES, *queries_media.ORACLES])
def test_against_sql(spark, sql, name):
    got = entry.queries()[name](spark, TABLES)
    cursor = sql.execute(entry.oracle_sql()[name])
    want_names = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    assert sorted(got.columns) == sorted(want_names)
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want_names, want)


@pytest.mark.parametrize("name", ["burst_similarity", "conflict_mixed_names", "p5_found"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, TABLES).count() >= 0


def test_normalized_text_of_every_document(spark, tmp_path):
    repaired, composed = ["repaired legacy charset mojibake"], ["normalized Unicode to NFC"]
    cases = [
        ("plain", "plain", []), ("", "", []), ("caf\u00c3\u00a9", "caf\u00e9", repaired), ("10 \u00c2\u00b0C", "10 \u00b0C", repaired), ("e\u0301", "\u00e9", composed),
        ("e\u00cc\u0081 \u00c3\u00a9", "\u00e9 \u00e9", [*repaired, *composed]),
        # correct capitals, and marks that are no Latin-1 reading, stay
        ("\u00c2ngela, S\u00c3O PAULO", "\u00c2ngela, S\u00c3O PAULO", []), ("it\u00e2\u20ac\u2122s", "it\u00e2\u20ac\u2122s", []), ("\u00c3\u00a9 e\u0301", "\u00c3\u00a9 \u00e9", composed),
    ]
    given = [(i, t) for i, (t, _, _) in enumerate(cases)] + [(99, None)]
    spark.createDataFrame(given, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.value, r.changes, r.fidelity_loss) for r in entry.queries()["normalized_text"](spark, str(tmp_path)).collect()}
    assert got == {i: (value, changes, False) for i, (_, value, changes) in enumerate(cases)}


def brute(text):
    """normalize_text of the reference, as its source reads."""
    changes = []
    if any(m in text for m in ("\u00c3", "\u00c2", "\u00e2\u20ac")):
        try:
            repaired = text.encode("latin-1").decode("utf-8")
        except UnicodeError:
            repaired = text
        if repaired != text:
            text, changes = repaired, ["repaired legacy charset mojibake"]
    after = unicodedata.normalize("NFC", text)
    return after, changes + (["normalized Unicode to NFC"] if after != text else [])


def test_normalized_text_against_brute_force(spark, sql):
    want = {i: brute(t) for i, t in sql.execute("SELECT doc_id, text FROM documents WHERE text IS NOT NULL").fetchall()}
    got = {r.doc_id: (r.value, r.changes) for r in entry.queries()["normalized_text"](spark, TABLES).collect()}
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).columns == ["camera_id", "start_us", "end_us", "duration_us", "n_ops"]


def test_media_run_has_the_files_of_a_few_operations_at_once(spark, sql, monkeypatch):
    root = session.new_folder(spark, "x").rpartition("/")[0].removeprefix("file://")
    before = set(os.listdir(root)) if os.path.isdir(root) else set()
    most, over = [0], threading.Event()

    def on_disk():
        new = [name for name in (os.listdir(root) if os.path.isdir(root) else []) if name not in before and name.startswith(("media-", "organized-", "staging-"))]
        return sum("part-" not in file and "_SUCCESS" not in file for name in new for _, _, files in os.walk(os.path.join(root, name)) for file in files)

    def watch():
        while not over.wait(0.002):
            most[0] = max(most[0], on_disk())

    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        monkeypatch.setattr(queries_media, "TURN", 7, raising=False)
        got = queries_media.media_run(spark, TABLES)
        rows = rows_of(got.columns, [tuple(r) for r in got.collect()])
    finally:
        over.set()
        watcher.join()
    cursor = sql.execute(entry.oracle_sql()["media_run"])
    names = [d[0] for d in cursor.description]
    assert rows == rows_of(names, cursor.fetchall()) and len(rows) > 300
    # four tasks, three files of an operation and as many copies, and a partial name beside a copy
    assert 0 < most[0] <= 4 * 7 * 6 < len(rows) and on_disk() == 0
