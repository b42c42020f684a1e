"""The llm operators against brute force, exact round trips and made cases."""

import bisect
import os

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from fotostrata.llm import canonical, garbled, history, packing, quality, tokens

VOCABULARY = os.path.join(tokens.TOKENIZERS, tokens.VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no tokenizer files")

# ---------------------------------------------------------------- 1: history


@pytest.mark.parametrize("path", [
    "/vault/lib/000001 Noël/IMG_0012.JPG", "\\vault\\lib\\000001 Noël\\IMG_0012.jpeg", "file:///vault/lib/000001%20No%C3%ABl/img_0012.jpg", "V:\\.\\vault\\lib\\000001  Noël\\Copy of IMG_0012.JPG",
    "/vault/lib/000001_Noël/../000001_Noël/IMG_0012 - Copy.JPG  ", "//vault//lib/000001 Noe\u0308l/IMG_0012(3).jpg", "/VAULT/LIB/000001 NOËL/copy_of_IMG_0012 - Cópia.jpg", "/vault/lib/000001 Noël/IMG_0012~1.JPG",
])
def test_one_file_in_many_spellings(path):
    assert history.normal_path(path) == "/vault/lib/000001 noël/img 0012.jpg"


@pytest.mark.parametrize("path", ["/vault/lib/000001 Noël/IMG_0012.dng", "/vault/lib/000001 Noël/IMG_0012_edited.jpg", "/vault/lib/000002 Noël/IMG_0012.jpg", "/vault/lib/000001 Noël/IMG_0013.jpg", "/vault/lib/000001 Noël/IMG_0012-web.jpg"])
def test_other_files_stay_other(path):
    assert history.normal_path(path) != "/vault/lib/000001 noël/img 0012.jpg"


def test_hash_spellings(spark):
    import base64
    import hashlib

    whole = hashlib.sha256(b"x").hexdigest()
    spelled = [whole, whole.upper(), f"sha256:{whole}", f"SHA256={whole.upper()}", f" {whole}\n", ":".join(whole[i : i + 8] for i in range(0, 64, 8)), base64.b64encode(bytes.fromhex(whole)).decode()]
    none = ["", "n/a", "pending", "0" * 64, "abc", None, "zz" * 32]
    df = spark.createDataFrame([(s,) for s in [*spelled, whole[:32], *none]], "h string")
    got = [None if r.n is None else bytes(r.n).hex() for r in df.select(history.normal_hash(F.col("h")).alias("n")).collect()]
    assert got == [whole] * len(spelled) + [whole[:32]] + [None] * len(none)


@settings(max_examples=30)
@given(st.integers(1, 12), st.integers(0, 10_000), st.sampled_from([0.0, 2.0, 6.0]))
def test_probed_cells_hold_every_vector_in_the_radius(cells, seed, radius):
    rng = np.random.default_rng(seed)
    members, queries = rng.integers(0, 16, (80, 16)).astype(float), rng.integers(0, 16, (10, 16)).astype(float)
    queries[:3] = members[:3]
    centres = history.fit_centroids(members[:40], cells)
    d = np.sqrt(((members[:, None].astype(float) - centres[None]) ** 2).sum(axis=2))
    cell = d.argmin(axis=1)
    inner = np.array([d[cell == k, k].min(initial=np.inf) for k in range(len(centres))])
    outer = np.array([d[cell == k, k].max(initial=-np.inf) for k in range(len(centres))])
    may = history.probe_cells(queries, centres, inner, outer, radius)
    near = np.sqrt(((queries[:, None].astype(float) - members[None]) ** 2).sum(axis=2)) <= radius
    for q, m in zip(*np.nonzero(near), strict=True):
        assert may[q, cell[m]]


@pytest.mark.parametrize("step", [None, 1])
def test_batches_against_history(spark, step):
    h = [f"{i:02x}" * 32 for i in range(1, 30)]
    ops = [
        (1, 1, "/a/x.jpg", h[0]), (2, 1, "/a/y.jpg", None), (3, 1, "/a/z.jpg", h[2]), (3, 1, "/a/z.jpg", h[2]), (4, 2, "/b/q.jpg", h[0].upper()), (5, 2, "/A/X copy.JPG", h[5]), (6, 2, "/i/1.jpg", h[9]),
        (7, 3, "/i/2.jpg", h[9][:32]), (8, 3, "/i/3.jpg", "pending"), (9, 3, None, None), (10, None, "/a/z.jpg", None), (11, 3, "/n/new.jpg", h[20]), (12, 3, "", "0" * 64), (None, 3, "/a/x.jpg", h[0]),
    ]
    df = spark.createDataFrame(ops, "op_id long, batch_id long, source string, content_hash string").withColumns({"cell": F.lit(1), "sig": F.lit("x")})
    batches = spark.createDataFrame([(1, "accepted"), (2, "new"), (3, "new")], "batch_id long, status string")
    groups = spark.createDataFrame([(h[9], "/i/0.jpg", ["/i/3.jpg", None]), (None, "/n/new.jpg", None), (h[2], None, None)], "content_hash string, original string, duplicates array<string>")
    got = sorted((r.op_id, r.accepted_op_id) for r in history.deduplicate(df, batches, groups, step).collect())
    assert got == [(4, 1), (5, 1), (7, 6), (8, 6)]
    assert history.deduplicate(df.limit(0), batches, groups).count() == 0 and history.deduplicate(df, batches.limit(0), groups.limit(0)).count() == 0


def test_brief_hashes_begin_whole_ones(spark):
    import hashlib

    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(6)]
    ops = [(1, 1, None, h[0]), (2, 1, None, h[1][:5]), (3, 1, None, h[2][:33]), (4, 2, None, h[0][:9]), (5, 2, None, h[1]), (6, 2, None, h[2].upper()), (7, 3, None, h[1][:7]), (8, 3, None, h[3][:15]), (9, 3, None, h[3][:40]), (10, 3, None, "0"), (11, 3, None, "0000"), (12, 3, None, h[4][:3])]
    df = spark.createDataFrame(ops, "op_id long, batch_id long, source string, content_hash string")
    batches = spark.createDataFrame([(1, "accepted"), (2, "new"), (3, "new")], "batch_id long, status string")
    groups = spark.createDataFrame([], "content_hash string, original string, duplicates array<string>")
    for step in (None, 1):
        assert sorted((r.op_id, r.accepted_op_id) for r in history.deduplicate(df, batches, groups, step).collect()) == [(4, 1), (5, 2), (6, 3), (7, 2), (9, 8)]


def test_path_vectors_count_trigrams():
    paths = [b"/a/img 0012.jpg", b"", b"ab", b"/a/img 0013.jpg", b"x" * 1000]
    for path, vector in zip(paths, history.path_vectors(paths), strict=True):
        want = [0] * 16
        for k in range(len(path) - 2):
            code = path[k] << 16 | path[k + 1] << 8 | path[k + 2]
            want[(code * 2654435761 & 0xFFFFFFFF) >> 28] += 1
        assert vector.tolist() == [min(255, w) for w in want]


@pytest.mark.parametrize("block", [50_000, 7])
def test_near_files_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(history, "BLOCK_ROWS", block)
    rng = np.random.default_rng(3)
    names = [f"/v/{rng.integers(4):02d} trip/{rng.choice(['IMG', 'DSC', 'scan'])}_{rng.integers(400):04d}{rng.choice(['', '_edited', '-web'])}.jpg" for _ in range(300)]
    rows = [*enumerate(names), (300, None), (301, " "), (302, "/quite/another/thing.tif"), (304, names[0].upper()), (None, "/x.jpg"), (306, names[1]), (306, names[1])]
    df = spark.createDataFrame(rows, "op_id long, source string").withColumns({"kind": F.lit("x"), "distance2": F.lit(1)})
    spelled = {i: history.normal_path(p).encode() for i, p in rows if i is not None and p and p.strip()}
    vectors = {i: history.path_vectors([p])[0].astype(int) for i, p in spelled.items()}
    for radius in (0.0, 5.0):
        want = {}
        for i in spelled:
            near = [(int(((vectors[i] - vectors[j]) ** 2).sum()), j) for j in spelled if j < i and spelled[j] != spelled[i]]
            if i % 2 == 0 and near and min(near)[0] <= radius * radius:
                want[i] = min(near)
        assert {r.op_id: (r.distance2, r.near_op_id) for r in history.near_files(df, radius, 2).collect()} == want
    assert history.near_files(df.limit(0)).count() == 0


def test_empty_history_keeps_its_outermost_signature(spark):
    # distances from the only centroid, zero, that single precision would round down and up
    rounding = lambda h: float(np.float32(d := np.sqrt(sum(int(c, 16) ** 2 for c in h[:16])))) - float(d)
    hashes = [f"{'c' * 15}{a:x}{'01' * 24}" for a in range(16)]
    for h in (min(hashes, key=rounding), max(hashes, key=rounding)):
        assert abs(rounding(h)) > 1e-6
        df = spark.createDataFrame([(1, 1, None, h), (2, 1, None, h), (3, 1, None, h)], "op_id long, batch_id long, source string, content_hash string")
        batches = spark.createDataFrame([(1, "new")], "batch_id long, status string")
        groups = spark.createDataFrame([], "content_hash string, original string, duplicates array<string>")
        assert sorted(tuple(x) for x in history.deduplicate(df, batches, groups).collect()) == [(1, 2), (1, 3)]


def test_an_index_is_opened_again_and_read_by_cell(spark, tmp_path):
    import hashlib

    h = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(400)]
    ops = [(i, 1 + i // 100, None, h[i % 150] if i % 2 else h[i]) for i in range(400)]
    df = spark.createDataFrame(ops, "op_id long, batch_id long, source string, content_hash string")
    groups = spark.createDataFrame([], "content_hash string, original string, duplicates array<string>")
    batches = lambda *new: spark.createDataFrame([(b, "new" if b in new else "accepted") for b in range(1, 5)], "batch_id long, status string")
    pairs = lambda found: sorted(tuple(x) for x in found.collect())
    folder = str(tmp_path / "index")
    want = pairs(history.deduplicate(df, batches(2, 3, 4), groups))
    got = pairs(history.deduplicate(df.where("batch_id <= 2"), batches(2), groups, folder=folder))
    # later runs see no row of the history
    for b in (3, 4):
        got += pairs(history.deduplicate(df.where(f"batch_id = {b}"), batches(b), groups, folder=folder))
    assert want and sorted(got) == want
    index = history.CellIndex.open(spark, folder)
    assert index.parts == 4 and len(index.centres[history.HASH]) > 1
    cells = [r[0] for r in index.entries().select("cell").distinct().collect()]
    one = index.entries(cells[:1])
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert 0 < one.count() < index.entries().count() and "PartitionFilters: [isnotnull" in plan and "cell" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert history.CellIndex.open(spark, str(tmp_path / "none")) is None


def test_a_third_of_all_rows_one_file(spark):
    df = spark.range(3000).select((F.col("id") + 1).alias("op_id"), (F.col("id") % 2 + 1).alias("batch_id"), F.when(F.col("id") % 3 == 0, "/hot/a.jpg").otherwise(F.concat(F.lit("/f/"), F.col("id"), F.lit(".jpg"))).alias("source"), F.lit(None).cast("string").alias("content_hash"))
    batches = spark.createDataFrame([(1, "accepted"), (2, "new")], "batch_id long, status string")
    groups = spark.createDataFrame([], "content_hash string, original string, duplicates array<string>")
    got = history.deduplicate(df, batches, groups).collect()
    assert len(got) == 500 and {r.accepted_op_id for r in got} == {1}


# ---------------------------------------------------------------- 2: canonical names

PLACES = [("city", 1, "Nova Memézowick", None), ("city", 2, "Sémbort", None), ("city", 3, "Bad Zãsüsetau", None), ("city", 4, "Vila Lecana", None), ("state", 9, "Parmetém do Sul", "PZ"), ("country", 5, "Röcknüsia", "RSI"), ("country", 6, "Trültéia", "TAA")]


@pytest.mark.parametrize(("kind", "value", "place"), [
    ("city", "NOVA MEMÉZOWICK", 1), ("city", "N0va Meméz0w1ck", 1), ("city", "City of Sémbort", 2), ("city", "near Sembort/PZ", 2), ("city", "Zãsüsetau, Bad", 3), ("city", "B. Zãsüsetau", 3), ("city", "Vila Le.", 4), ("city", "S&#233;mbort *", 2),
    ("city", "Ｓéｍｂｏｒｔ", 2), ("city", "Sembrot", 2), ("city", "Campsite 4", -1), ("city", "x" * 50_000, -1), ("city", "!!!", -1), ("state", "pz", 9), ("state", "do Sul, Parmetém", 9), ("state", "Parmetémdo Sul", 9), ("country", "R.S.I.", 5),
    ("country", "Republic of Trültéia", 6), ("country", "Trulteai", 6), ("country", "none", -1),
])
def test_canonical_values(kind, value, place):
    names = canonical.CanonicalList([(p, n, c) for k, p, n, c in PLACES if k == kind])
    assert names.match(value) == place


def test_longest_mention_wins_and_ties_map_to_none():
    names = canonical.CanonicalList([(1, "Alba", None), (2, "Alba Nova", None), (3, "Carlon", None), (4, "Carlot", None)])
    assert [m[2] for m in names.mentions(canonical.fold("from Alba Nova to alba"))] == [2, 1]
    assert names.match("to Alba Nova") == 2 and names.match("Carlo") == -1


@given(st.text("abcd", max_size=9), st.text("abcd", max_size=9))
def test_edit_distance(a, b):
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if not i or not j}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    want = d[len(a), len(b)]
    assert canonical.edit_distance(a, b, 9) == want and (want <= 2) == (canonical.edit_distance(a, b, 2) <= 2)


def test_bags_count_very_long_values():
    assert canonical._bag("a" * 40_000)[1] == 40_000


def test_the_filter_loses_no_candidate():
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("abc"), rng.integers(3, 9))) for _ in range(60)]
    names = canonical.CanonicalList([(i, w, None) for i, w in enumerate(words)])
    for value in ["".join(rng.choice(list("abc"), rng.integers(2, 11))) for _ in range(60)]:
        got, want = {}, {}
        names.similar(value, 0.39, got)
        for i, n in zip(names.ids, names.names, strict=True):
            longest = max(len(n), len(value))
            d = canonical.edit_distance(value, n, int(0.39 * longest))
            if d <= int(0.39 * longest):
                want[i] = d / longest
        assert got == want


def test_mapping_table(spark):
    places = spark.createDataFrame(PLACES, "kind string, place_id long, name string, code string")
    rows = [("city", 1, "sembort"), ("city", 2, "Sémbort"), ("city", 3, " \u00a0"), ("city", 4, None), ("city", 5, "sembort"), ("city", 5, "sembort"), (None, 6, "x"), ("planet", 7, "Mars")]
    values = spark.createDataFrame(rows, "field string, record_id long, value string").withColumns({"n_rows": F.lit(1), "place_id": F.lit("clash")})
    got = sorted(tuple(r) for r in canonical.map_to_canonical(values, places).collect())
    assert got == [("city", 1, 2), ("city", 5, 2), ("city", 5, 2), ("planet", 7, -1)]
    assert {r.place_id for r in canonical.map_to_canonical(values, places.limit(0)).collect()} == {-1}
    assert canonical.map_to_canonical(values.limit(0), places).count() == 0


# ---------------------------------------------------------------- 4: garbled texts

CLEAN = ["Coração na praça", "São João em Paraty", "Manhã de verão", "Estação às margens", "Montaña roja", "Año nuevo cerca de Rio", "Niños jugando", "Große Öffnung", "Über den Dächern", "Straßenfest bei Köln", "Frühling", "Déjà l’été",
         "Fête d’été près de Lyon", "Forêt enneigée", "Первый снег и вечер", "Горы зимой", "Вечер у реки", "夏祭りの夜", "港の夕日", "Θάλασσα και ουρανός", "Źródło", "Święto żniw", "Dzień śniegu", "Ï is rare", "The river at dusk"]


@pytest.fixture(scope="module")
def restorer():
    texts = {}
    for k in range(4):  # letters count as a language's own from the second text on
        for t in CLEAN:
            texts.setdefault(garbled.language_of(t), []).append(f"{t} {k}")
    return garbled.Restorer(texts)


@pytest.mark.parametrize("text", [t for t in CLEAN if not t.isascii() and t != "Ï is rare"])
@pytest.mark.parametrize("read_as", ["cp1252", "cp437", "cp850", "mac_roman", "cp1251"])
def test_utf8_read_wrongly_comes_back(restorer, text, read_as):
    try:
        wrong = text.encode().decode(read_as)
    except UnicodeDecodeError:
        pytest.skip("not every byte is a character there")
    assert restorer.restore(wrong) == text
    assert restorer.restore(f'{{"x-default": "{wrong}"}}') == f'{{"x-default": "{text}"}}'


def test_other_garbling(restorer):
    assert restorer.restore("Coração".encode().decode("cp1252").encode().decode("cp1252")) == "Coração"
    assert restorer.restore("Вечер у реки".encode("cp1251").decode("cp1252")) == "Вечер у реки"
    assert restorer.restore("港の夕日".encode("shift_jis").decode("latin-1")) == "港の夕日"
    assert restorer.restore("Stra▀enfest 5") == "Straßenfest 5" and restorer.restore("Manh&#195;&#163;") == "Manhã"
    assert restorer.restore("Verão (25); FÃªte dâ€™Ã©tÃ©") == "Verão (25); Fête d’été"


def test_lost_bytes_and_clean_texts(restorer):
    assert restorer.restore("Stra\ufffdenfest") == "" and restorer.restore("DÃ©jÃ\u00a0 lâÃ©tÃ©") == "" and restorer.restore("ÅÄka w lesie") == ""
    for clean in [*CLEAN, "Â and Ê (caps sheet)", "MAÇÃ E LIMÃO", "ÃO: sufixo", "25 °C – test", "© archive ½ frame", "┌ frame ┐", "«Ночь»", "plain", "x² ≤ 9 √ ok", "Straße / Verão | Год"]:
        assert restorer.restore(clean) is None, clean


def test_restore_table(spark):
    rows = [("t", i, f"{t} {i % 5}") for i, t in enumerate(CLEAN * 6)] + [("t", 900, "ManhÃ£ de verÃ£o"), ("u", 901, "ManhÃ£ de verÃ£o"), ("u", 901, "ManhÃ£ de verÃ£o"), ("t", 902, None), ("t", 903, ""), ("t", 904, "a" * 200_000)]
    df = spark.createDataFrame(rows, "source_table string, record_id long, value string").withColumns({"n_rows": F.lit(1), "restored": F.lit("clash")})
    got = sorted(tuple(r) for r in garbled.restore_garbled(df).collect())
    assert got == [("t", 900, "Manhã de verão"), ("u", 901, "Manhã de verão"), ("u", 901, "Manhã de verão")]
    assert garbled.restore_garbled(df.limit(0)).count() == 0


def test_models_are_counted_over_all_clean_texts(spark):
    many = [f"Straßenfest bei Köln Nr. {k}" for k in range(3000)] + ["Ünder łubin bei Köln", "Öffnung łubin bei Köln", "Schöne Grüße an Noël", "Öffnung am Fluß", "Große " + "Öffnung für den Frühling " * 20]
    df = spark.createDataFrame([("t", k, v) for k, v in enumerate(many)] + [("u", 0, "Straßenfest bei Köln Nr. 1")], "source_table string, record_id long, value string")
    phrases, letters = garbled.language_models(df.repartition(4))
    assert {"bei", "Köln", "bei Köln", "Straßenfest bei"} <= set(phrases["de"][-8:])
    assert {"Schöne Grüße", "an Noël", "Frühling Öffnung", "Große"} <= set(phrases["de"])
    assert {"ß", "ö", "ü", "Ö"} <= letters["de"] and "ë" not in letters["de"]  # Ö stands in two texts of 3,003, ë in one
    assert letters["pl"] == {"ł", "ö"} and "łubin bei" in phrases["pl"]
    assert garbled.language_models(df.limit(0)) == ({}, {})


# ---------------------------------------------------------------- 7: tokens

TEXTS = ["a b", "", None, "  two  spaces \n\n\t x", "it's 漢字 🙂 naïve'll", "x" + "qzxjvkwy" * 4000 + " end", "<|endoftext|>", "\u00a0\u2003 \u0085", "a" * 70_000]


@needs_vocabulary
@pytest.mark.parametrize("hot", [50_000, 2, 0])
def test_encoding_and_decoding(spark, monkeypatch, hot):
    monkeypatch.setattr(tokens, "HOT_WORDS", hot)
    docs = spark.createDataFrame([*enumerate(TEXTS), (None, "lost")], "doc_id long, text string").withColumns({"word": F.lit(1), "pos": F.lit(2), "ids": F.lit("clash")})
    encoded = tokens.encode_corpus(docs)
    got = {r.doc_id: list(r.ids) for r in encoded.collect()}
    enc = tokens.encoder(VOCABULARY)
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.text for r in tokens.decode_corpus(encoded).collect()} == {i: t or "" for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokens.token_counts(docs).collect()} == {i: len(x) for i, x in got.items()}
    assert tokens.encode_corpus(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 8: packing


def brute_sheets(sizes, capacity):
    """Best-fit decreasing, item by item."""
    rooms, sheets = [], 0
    for size in sorted((p for s in sizes for p in ([capacity] * (s // capacity) + ([s % capacity] if s % capacity or not s else []))), reverse=True):
        k = bisect.bisect_left(rooms, size)
        if k == len(rooms):
            sheets += 1
            room = capacity
        else:
            room = rooms.pop(k)
        bisect.insort(rooms, room - size)
    return sheets, sorted(rooms)


def placed(segments, counts):
    at = {}
    for i, (size, rank, first, each) in enumerate(segments):
        last = next((s[1] for s in segments[i + 1 :] if s[0] == size), counts[size])
        for r in range(rank, last):
            at.setdefault(first + (r - rank) // each, []).append(size)
    return at


@settings(max_examples=150)
@given(st.lists(st.integers(0, 24), max_size=60), st.integers(1, 24))
def test_histogram_packing_is_best_fit_decreasing(sizes, capacity):
    sizes = [min(s, capacity) for s in sizes]
    counts = {s: sizes.count(s) for s in set(sizes)}
    segments, n = packing.pack_histogram(counts, capacity)
    sheets = placed(segments, counts)
    assert sorted(s for x in sheets.values() for s in x) == sorted(sizes) and all(sum(x) <= capacity for x in sheets.values())
    want, rooms = brute_sheets(sizes, capacity)
    assert n == want == len(sheets) and sorted(capacity - sum(x) for x in sheets.values()) == rooms


@given(st.sets(st.integers(0, 40)), st.integers(0, 40))
def test_room_tree_finds_the_tightest(rooms, least):
    tree = packing.RoomTree(40)
    for r in rooms:
        tree.set(r, True)
    assert tree.tightest(least) == min((r for r in rooms if r >= least), default=-1)


def test_packing_table(spark):
    sizes = [0, None, -5, 3, 10, 25, 25, 4, 6, 10, 1, *[7] * 40]
    df = spark.createDataFrame([*enumerate(sizes), (None, 4)], "doc_id long, n_tokens long").withColumns({"salt": F.lit("x"), "rank": F.lit(1)})
    rows = packing.pack_documents(df, 10).collect()
    whole = [max(0, s or 0) for s in sizes]
    assert {r.doc_id: 0 for r in rows}.keys() == set(range(len(sizes)))
    for doc, size in enumerate(whole):
        own = sorted((r.piece, r.tokens) for r in rows if r.doc_id == doc)
        assert [t for _, t in own] == ([10] * (size // 10) + ([size % 10] if size % 10 or not size else [])) and [p for p, _ in own] == list(range(len(own)))
    used = {}
    for r in rows:
        used[r.sheet] = used.get(r.sheet, 0) + r.tokens
    assert max(used.values()) <= 10 and len(used) == brute_sheets(whole, 10)[0]
    assert packing.pack_documents(df.limit(0), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack_documents(df, 0)


# ---------------------------------------------------------------- 9: quality

PROSE = ["The old scanner was moved next to the window because the light was still soft. By then, nobody in the group had noticed it.",
         "I don't remember much, but the album belongs with the picture of the pier. We came back from the coast on the last evening!",
         "There were 14 frames of the garden; we kept three of them although the name of the place is missing (IMG_1002.jpg)."]
OTHER = [
    ("list", "1. the pier\n2. the old tram\n3. a blurred dog\n4. the roofs\n5. the fair"), ("list", "- milk\n- bread\n- eggs\n- salt\n- tea"), ("list", "#Pier #Tram #Roofs #Fair #Garden #School"), ("list", "Packing\n[x] boots\n[ ] tent\n[x] lamp\n[ ] map\n[ ] rope"),
    ("table", "city;iso;frames\nRio;100;4\nParaty;200;12\nLyon;400;3\nKoeln;100;7"), ("table", "<table><tr><td>a</td><td>b</td></tr><tr><td>1</td><td>2</td></tr></table>"), ("table", "| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |"),
    ("table", "city      iso   frames\nRio       100   4\nParaty    200   12\nLyon      400   3"), ("junk", "photo " * 60), ("junk", "8d 05 b4 63 ed f2 02 29\nf3 97 5e 8b 28 8f 04 51\nd4 83 12 a7 4d f3 e5 0a"), ("junk", "~: $#_&/%(&/$ ;-%:}-?:}#@_].\\^@^:]~ +_]]#%~^!|;&%"),
    ("junk", "Print | Home | Share | Next > | Help | Home | Print | Top | Share | Help"),
]


def test_quality_kinds(spark):
    docs = [(i, PROSE[i % 3] + " " + PROSE[(i + 1 + i // 3) % 3]) for i in range(240)]
    odd = {1000 + i: kind for i, (kind, _) in enumerate(OTHER)}
    rows = docs + [(1000 + i, t) for i, (_, t) in enumerate(OTHER)] + [(5000, None), (5001, ""), (5002, " \u00a0\n"), (None, "x"), (5003, " ".join(PROSE) * 300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(1), "stats": F.lit("clash")})
    judged = {r.doc_id: r for r in quality.judge_documents(df).collect()}
    assert set(judged) == {i for i, _ in docs} | set(odd) | {5003}
    assert {k: r.kind for k, r in judged.items() if r.kind} == odd
    for r in judged.values():
        assert abs(sum(r.contributions) - r.distance2) < 1e-6 * max(1, abs(r.distance2))
    assert judged[1000].distance2 > 10 * np.median([judged[i].distance2 for i, _ in docs])


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge_documents(empty).count() == 0
    alone = spark.createDataFrame([(1, "zzz qqq")], "doc_id long, text string")
    assert quality.judge_documents(alone).count() == 1
