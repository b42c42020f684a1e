"""Checking new batches of files against everything accepted before.

A file is known by up to two signatures. Its content hash is a vector of 16
hexadecimal digits. Its path, in one spelling, is a vector of 16 counts of
hashed character trigrams, so that files of one folder and names that differ a
little lie close together. The vectors are kept whole in an inverted file: each
lies in the cell of its nearest centroid, and a cell is a partition of the table
in the shared folder. A probe visits only cells that can hold a vector within
the radius by the triangle inequality: not farther from the centroid than the
cell's outermost member, not nearer than its innermost, and not beyond half the
difference to the nearest centroid. Candidates are reranked exactly.

"The same file" is radius 0: candidates share the vector, and the rest of the
signature decides. Near files (``near_files``) are found at any radius: first the
own cell, then only the cells that can still hold a nearer one.

Accepting a batch appends its vectors to the cells and reads the cells it
probes. An index in a folder of its own is opened again by a later run, which
then reads only what is new. The number of cells grows with the first history.

Scale: copies are reduced to one entry per signature (with map-side combining)
before anything is shuffled, so a file delivered a billion times is one entry.
"""

from __future__ import annotations

import hashlib
import posixpath
import re
import unicodedata
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotostrata.operators.lookup import skewed_lookup
from fotostrata.session import materialise, new_folder

#: Coordinates of a vector.
DIMS = 16
#: Cells of each kind: the square root of the first history's rows over this, and at least so many.
ROWS_TO_CELLS, LEAST_CELLS = 20, 32
#: The centroids are fitted on at most so many vectors of each kind; all vectors are indexed.
FIT_SAMPLE = 8_192
#: Members of a cell that one task compares with the queries at a radius above 0.
BLOCK_ROWS = 50_000
#: A brief hash (cut within a byte, or shorter than a vector) has no vector; LACKING is an operation whose hash says nothing.
HASH, PATH, BRIEF, LACKING = 0, 1, 2, 3
NO_CELL = -1

# Marks of copying in a file name, and spellings of one format.
_COPY_BEFORE = re.compile(r"^(?:copy of|cópia de|copia de|kopie von|copie de)\s+")
_COPY_AFTER = re.compile(r"(?:\s*-\s*|\s+)(?:copy|cópia|copia|kopie|copie)(?:\s*\(?\d+\)?)?$|\s*\(\d+\)$|~\d+$")
_SAME_FORMAT = {".jpeg": ".jpg", ".jpe": ".jpg", ".tiff": ".tif", ".heif": ".heic"}


def normal_path(path: str) -> str:
    """The file a path names, in one spelling: without scheme, drive, escapes, dots, case, blanks and marks of copying."""
    text = unquote(path) if "%" in path else path
    text = unicodedata.normalize("NFC", text).replace("\\", "/")
    text = re.sub(r"^\s*file:/*", "/", text, flags=re.I)
    text = re.sub(r"^\s*[A-Za-z]:(?=/)", "", text)
    text = re.sub(r"[\s_]+", " ", text).casefold()
    text = re.sub(r"\s*/[\s/]*", "/", text).strip()
    text = posixpath.normpath(text) if text else ""
    folder, name = posixpath.split(text)
    stem, ext = posixpath.splitext(name)
    ext = _SAME_FORMAT.get(ext.strip(), ext.strip())
    before = None
    while stem != before and stem:
        before = stem
        stem = _COPY_AFTER.sub("", _COPY_BEFORE.sub("", stem.strip())).strip() or before
    return f"{folder}/{stem}{ext}"


def _digits(text: Column) -> Column:
    """The hexadecimal digits of a SHA-256 hash however it is written, whole or cut short; null if it says nothing."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    coded = F.lower(F.hex(F.try_to_binary(plain, F.lit("base64"))))
    digits = F.regexp_replace(F.regexp_replace(F.lower(plain), r"^sha-?256\s*[:=]?\s*", ""), r"[\s:\-]", "")
    digits = F.when(plain.rlike(r"^[A-Za-z0-9+/]{43}=$"), coded).otherwise(digits)
    return F.when(digits.rlike(r"^[0-9a-f]{1,64}$") & ~digits.rlike(r"^(.)\1*$"), digits)


def normal_hash(text: Column) -> Column:
    """The bytes of a hash of whole bytes and at least DIMS digits; null for any other."""
    digits = _digits(text)
    return F.when((F.length(digits) >= DIMS) & (F.length(digits) % 2 == 0), F.unhex(digits))


def brief_hash(text: Column) -> Column:
    """The digits, as bytes, of a hash that normal_hash leaves out; null if the text says nothing."""
    digits = _digits(text)
    return F.when((F.length(digits) < DIMS) | (F.length(digits) % 2 == 1), F.encode(digits, "utf-8"))


def path_vectors(paths: list[bytes]) -> np.ndarray:
    """Counts of each path's byte trigrams, hashed to DIMS buckets, at most 255 a bucket."""
    flat = np.frombuffer(b"\0".join(paths) + b"\0\0\0", np.uint8).astype(np.uint32)
    row = np.cumsum(flat == 0)[:-2] - (flat[:-2] == 0)
    whole = (flat[:-2] != 0) & (flat[1:-1] != 0) & (flat[2:] != 0)
    shingle = (flat[:-2] << 16) | (flat[1:-1] << 8) | flat[2:]
    bucket = ((shingle * np.uint32(2654435761)) >> np.uint32(28)).astype(np.int64)  # the upper four bits: DIMS buckets
    counts = np.bincount(row[whole] * DIMS + bucket[whole], minlength=len(paths) * DIMS)
    return np.minimum(counts[: len(paths) * DIMS].reshape(-1, DIMS), 255).astype(np.uint8)


def with_signatures(files: DataFrame, source: str = "source") -> DataFrame:
    """``files`` with path_sig, the vector and the digest of the normalised path (null for a null or blank path)."""
    rest = [f for f in files.schema.fields if f.name != source]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(source)).to_pylist()
            spelled = [None if p is None or not p.strip() else normal_path(p).encode("utf-8", "surrogatepass").replace(b"\0", b" ") for p in texts]
            vectors = path_vectors([p or b"" for p in spelled])
            sigs = [None if p is None else v.tobytes() + hashlib.blake2b(p, digest_size=12).digest() for p, v in zip(spelled, vectors, strict=True)]
            keep = [batch.column(batch.schema.get_field_index(f.name)) for f in rest]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sigs, pa.binary())], names=[*(f.name for f in rest), "path_sig"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest) + ", path_sig binary"
    return files.mapInArrow(run, schema)


def _vectors(signatures: list[bytes], kind: int) -> np.ndarray:
    """The coordinates of signatures of one kind: hexadecimal digits of a hash, counts of a path."""
    if kind == PATH:
        return np.frombuffer(b"".join(s[:DIMS] for s in signatures), np.uint8).reshape(-1, DIMS).astype(np.float64)
    raw = np.frombuffer(b"".join(s[: DIMS // 2] for s in signatures), np.uint8).reshape(-1, DIMS // 2)
    return np.stack([raw >> 4, raw & 15], axis=2).reshape(-1, DIMS).astype(np.float64)


def distances(vectors: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Distances of vectors (rows) to centres (columns)."""
    squared = (vectors**2).sum(axis=1)[:, None] - 2 * vectors @ centres.T + (centres**2).sum(axis=1)[None]
    return np.sqrt(np.maximum(squared, 0))


def fit_centroids(sample: np.ndarray, cells: int = LEAST_CELLS, rounds: int = 5) -> np.ndarray:
    """Plain k-means from evenly spaced sample vectors."""
    if not len(sample):
        return np.zeros((1, DIMS))
    centres = sample[np.linspace(0, len(sample) - 1, min(cells, len(sample))).astype(int)].astype(np.float64)
    for _ in range(rounds):
        nearest = distances(sample, centres).argmin(axis=1)
        for k in np.unique(nearest):
            centres[k] = sample[nearest == k].mean(axis=0)
    return np.unique(centres, axis=0)


def least_distances(d: np.ndarray, inner: np.ndarray, outer: np.ndarray) -> np.ndarray:
    """How near a member of each cell (columns) can at best be to each vector (rows), of its distances ``d`` to the centroids."""
    bounds = np.maximum(d - outer, inner - d)
    return np.maximum(np.maximum(bounds, (d - d.min(axis=1, keepdims=True)) / 2), 0)


#: What rounding may take from a distance.
SLACK = 1e-3


def probe_cells(vectors: np.ndarray, centres: np.ndarray, inner: np.ndarray, outer: np.ndarray, radius: float) -> np.ndarray:
    """Which cells (columns) can hold a vector within ``radius`` of each vector (rows), by distance bounds."""
    return least_distances(distances(vectors, centres), inner, outer) <= radius + SLACK


class CellIndex:
    """Persisted inverted-file cells: (part, cell, kind, vector, tail, first_op, n_ops, distance), a signature being vector and tail.

    Each delivery is a part of the folder, partitioned by cell, so that a reader
    of some cells opens no other files. The cells' bounds lie beside the parts with
    the centroids and are kept up to date as parts are written. A part counts once
    its bounds are written; one writer at a time.
    """

    STORED = "kind int, vector binary, tail binary, first_op long, n_ops long, distance double, part int, cell int"

    def __init__(self, spark: SparkSession, folder: str, centres: dict[int, np.ndarray]):
        self.spark, self.folder, self.centres, self.parts = spark, folder, centres, 0
        self.first = {HASH: 0, PATH: len(centres[HASH])}  # the number of each kind's first cell
        cells = sum(map(len, centres.values()))
        self.inner, self.outer, self.rows = np.full(cells, np.inf), np.full(cells, -np.inf), np.zeros(cells, np.int64)
        self.brief_lengths: set[int] = set()

    @classmethod
    def build(cls, entries: DataFrame, signatures: DataFrame | None = None, folder: str | None = None) -> CellIndex:
        """A new index over ``entries`` (kind, sig, first_op, n_ops); the centroids are fitted on a bounded sample of ``signatures`` (default: the entries)."""
        spark, source, centres = entries.sparkSession, entries if signatures is None else signatures, {}
        counts = {r[0]: r[1] for r in source.groupBy("kind").agg(F.count(F.lit(1))).collect()}
        for kind in (HASH, PATH):
            n = counts.get(kind, 0)
            sample = [bytes(r[0]) for r in source.where(F.col("kind") == kind).select("sig").limit(FIT_SAMPLE).collect()] if n else []
            cells = max(LEAST_CELLS, int(n**0.5) // ROWS_TO_CELLS)
            centres[kind] = fit_centroids(_vectors(sample, kind) if sample else np.zeros((0, DIMS)), cells)
        index = cls(spark, folder or new_folder(spark, "cells"), centres)
        rows = [(kind, k, c.tolist()) for kind in centres for k, c in enumerate(centres[kind])]
        spark.createDataFrame(rows, "kind int, k int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{index.folder}/centres")
        index.append(entries)
        return index

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CellIndex | None:
        """The index an earlier run left in ``folder``; null if there is none, or if its first part was not finished."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/bounds/part=0/_SUCCESS")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return None
        rows = spark.read.parquet(f"{folder}/centres").orderBy("kind", "k").collect()
        index = cls(spark, folder, {kind: np.array([r.centre for r in rows if r.kind == kind], np.float64) for kind in (HASH, PATH)})
        for r in spark.read.schema("cell int, lo double, hi double, n long, length int, part int").parquet(f"{folder}/bounds").collect():
            index._widen(r.cell, r.lo, r.hi, r.n, r.length)
            index.parts = max(index.parts, r.part + 1)
        return index

    def _widen(self, cell: int | None, lo: float, hi: float, n: int, length: int | None) -> None:
        """Takes distances into the bounds of a cell; NO_CELL has the brief hashes of a length, and no cell at all marks the part alone."""
        if cell is None:
            return
        if cell == NO_CELL:
            self.brief_lengths.add(length)
        else:
            self.inner[cell], self.outer[cell], self.rows[cell] = min(self.inner[cell], lo), max(self.outer[cell], hi), self.rows[cell] + n

    def _assign(self, entries: DataFrame) -> DataFrame:
        """Each entry with its own cell, the distance to the centroid, its vector and the rest of its signature."""
        centres, first, names = self.centres, self.first, ["kind", "sig", "first_op", "n_ops"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sigs, kinds = batch.column(1).to_pylist(), np.asarray(batch.column(0))
                cell, near = np.full(len(sigs), NO_CELL, np.int32), np.zeros(len(sigs))
                cut = np.where(kinds == PATH, DIMS, np.where(kinds == HASH, DIMS // 2, 0)).tolist()
                for kind in (HASH, PATH):
                    own = np.flatnonzero(kinds == kind)
                    for at in range(0, len(own), 4096):
                        some = own[at : at + 4096]
                        d = distances(_vectors([sigs[i] for i in some], kind), centres[kind])
                        nearest = d.argmin(axis=1)
                        cell[some], near[some] = nearest + first[kind], d[np.arange(len(d)), nearest]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([s[:k] for s, k in zip(sigs, cut, strict=True)], pa.binary()), pa.array([s[k:] for s, k in zip(sigs, cut, strict=True)], pa.binary()),
                     batch.column(2), batch.column(3), pa.array(near), pa.array(cell)],
                    names=["kind", "vector", "tail", "first_op", "n_ops", "distance", "cell"],
                )

        return entries.select(*names).mapInArrow(run, "kind int, vector binary, tail binary, first_op long, n_ops long, distance double, cell int")

    def append(self, entries: DataFrame) -> DataFrame:
        """Adds entries to their cells as a new part, and returns that part."""
        path = f"{self.folder}/parts/part={self.parts}"
        # a part without bounds is what a broken run left
        self._assign(entries).repartition("cell").write.partitionBy("cell").mode("overwrite").parquet(path)
        part = self.spark.read.schema(self.STORED.replace(" part int,", "")).parquet(path)
        length = F.when(F.col("cell") == NO_CELL, F.length("tail"))
        found = part.groupBy("cell", length.alias("length")).agg(F.min("distance").alias("lo"), F.max("distance").alias("hi"), F.count(F.lit(1)).alias("n"))
        bounds = [tuple(r) for r in found.select("cell", "lo", "hi", "n", "length").collect()]
        # the mark keeps the number of a part without entries
        kept = self.spark.createDataFrame([(None, 0.0, 0.0, 0, None), *bounds], "cell int, lo double, hi double, n long, length int").coalesce(1)
        kept.write.mode("overwrite").parquet(f"{self.folder}/bounds/part={self.parts}")
        for row in bounds:
            self._widen(*row)
        self.parts += 1
        return part

    def entries(self, cells: list[int] | None = None) -> DataFrame:
        """The entries of all finished parts, or of some cells of them."""
        rows = self.spark.read.schema(self.STORED).parquet(f"{self.folder}/parts").where(F.col("part") < self.parts)
        return rows if cells is None else rows.where(F.col("cell").isin(cells))

    def _route(self, queries: DataFrame, radius: float, reach: str | None = None, own: bool = False) -> DataFrame:
        """``queries`` (kind, vector, ...) once for each cell that can hold a vector within the radius, as ``probed``.

        ``reach`` names a column with a smaller radius of the row's own. With
        ``own`` a row goes to the cell of its nearest centroid alone, without it
        to the other ones only if ``reach`` is given.
        """
        centres, first, names, inner, outer = self.centres, self.first, queries.columns, self.inner, self.outer

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kinds, vectors = np.asarray(batch.column(names.index("kind"))), batch.column(names.index("vector")).to_pylist()
                limit = np.full(len(kinds), radius) if reach is None else np.minimum(radius, np.asarray(batch.column(names.index(reach)).fill_null(np.inf)))
                who, cell = [], []
                for kind in (HASH, PATH):
                    mine = np.flatnonzero(kinds == kind)
                    part = slice(first[kind], first[kind] + len(centres[kind]))
                    for at in range(0, len(mine), 4096):
                        some = mine[at : at + 4096]
                        d = distances(_vectors([vectors[i] for i in some], kind), centres[kind])
                        may = least_distances(d, inner[part], outer[part]) <= limit[some, None] + SLACK
                        nearest = np.zeros_like(may)
                        nearest[np.arange(len(d)), d.argmin(axis=1)] = True
                        may &= nearest if own else ~nearest if reach is not None else True
                        rows, columns = np.nonzero(may)
                        who.append(some[rows])
                        cell.append(columns + first[kind])
                at = np.concatenate(who) if who else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array((np.concatenate(cell) if cell else at).astype(np.int32))], names=[*names, "probed"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
        return queries.mapInArrow(run, f"{schema}, probed int")

    def probe(self, queries: DataFrame) -> DataFrame:
        """(kind, vector, tail, first_op, n_ops, found_op) of ``queries`` (the first five): the least first_op of an entry of the same file; those without one are left out."""
        names = ["kind", "vector", "tail", "first_op", "n_ops"]
        routed = materialise(self._route(queries.select(*names), 0.0), "routed")
        probed = sorted(r[0] for r in routed.select("probed").distinct().collect())
        members = self.entries(probed).select(F.col("cell").alias("probed"), "vector", F.col("tail").alias("member"), F.col("first_op").alias("member_op"))
        # at distance 0 the vectors are equal; the exact rerank: whole signatures are equal, or a cut-short hash begins the other
        same = F.startswith("tail", F.col("member")) | F.startswith("member", F.col("tail"))
        found = routed.join(members, ["probed", "vector"]).where(same).select(*names, "member_op")
        brief = self._probe_brief(queries.select(*names))
        found = found if brief is None else found.unionByName(brief)
        return found.groupBy(*names).agg(F.min("member_op").alias("found_op"))

    def _probe_brief(self, queries: DataFrame) -> DataFrame | None:
        """Matches in which a brief hash begins the other one; there are at most 64 lengths of them."""
        digits = F.when(F.col("kind") == BRIEF, F.decode("tail", "utf-8")).otherwise(F.lower(F.hex(F.concat("vector", "tail"))))
        asked = sorted(r[0] for r in queries.where(F.col("kind") == BRIEF).select(F.length("tail")).distinct().collect()) if self.brief_lengths else []
        if not self.brief_lengths:  # the batch is in the index: there are none in it either
            return None
        begins = lambda rows, lengths: rows.withColumn("prefix", F.explode(F.array_compact(F.array(*[F.when(F.length("digits") >= k, F.substring("digits", 1, k)) for k in lengths]))))
        hashes = queries.where(F.col("kind") != PATH).withColumn("digits", digits)
        members = self.entries().where(F.col("kind") != PATH).withColumn("digits", digits)
        # short prefixes are the frequent ones
        short = members.where(F.col("kind") == BRIEF).groupBy(F.col("digits").alias("prefix")).agg(F.min("first_op").alias("member_op")).withColumn("weight", -F.length("prefix"))
        found = skewed_lookup(begins(hashes, sorted(self.brief_lengths)), short, ["prefix"], "weight").select(*queries.columns, "member_op")
        if asked:
            longer = begins(members, asked).groupBy("prefix").agg(F.min("first_op").alias("member_op"))
            found = found.unionByName(hashes.where(F.col("kind") == BRIEF).join(longer, F.col("digits") == F.col("prefix")).select(*queries.columns, "member_op"))
        return found

    def nearest(self, queries: DataFrame, radius: float) -> DataFrame:
        """(op_id, near_op, distance2) of ``queries`` (op_id, kind, vector, tail): the nearest entry of another signature that came before, within the radius.

        Exact: the own cell is searched first; then those cells that can hold a
        nearer one still. Of equally near entries the smallest first_op counts.
        Members of a cell are compared in blocks of bounded size.
        """
        asked = materialise(queries.select("op_id", "kind", "vector", "tail"), "asked")
        near = materialise(self._compare(self._route(asked, radius, own=True)), "near")
        reach = asked.join(near.select("op_id", "kind", F.sqrt("distance2").alias("reach")), ["op_id", "kind"], "left")
        farther = self._compare(self._route(reach, radius, reach="reach").drop("reach"))
        best = near.unionByName(farther).groupBy("op_id", "kind").agg(F.min(F.struct("distance2", "near_op")).alias("b"))
        return best.where(F.col("b.distance2") <= radius * radius).select("op_id", "kind", F.col("b.near_op").alias("near_op"), F.col("b.distance2").alias("distance2"))

    def _compare(self, routed: DataFrame) -> DataFrame:
        """(op_id, kind, near_op, distance2): the nearest earlier entry of another signature in each query's probed cells, block by block."""
        blocks = {int(c): int(-(-n // BLOCK_ROWS)) for c, n in enumerate(self.rows) if n}
        number = F.create_map(*[F.lit(x) for pair in blocks.items() for x in pair]) if blocks else F.create_map(F.lit(-2), F.lit(1))
        routed = materialise(routed, "compared")
        probed = sorted(r[0] for r in routed.select("probed").distinct().collect())
        # a cell of several blocks meets each query in all of them
        left = routed.withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce(F.try_element_at(number, "probed"), F.lit(1)) - 1)))
        members = self.entries(probed).select(F.col("cell").alias("probed"), "vector", "tail", "first_op")
        members = members.withColumn("block", F.pmod(F.xxhash64("vector", "tail"), F.coalesce(F.try_element_at(number, "probed"), F.lit(1))).cast("int"))
        first_path = self.first[PATH]

        def compare(key, here, there):
            out = {"op_id": [], "kind": [], "near_op": [], "distance2": []}
            if len(here) and len(there):
                kind = PATH if key[0] >= first_path else HASH
                theirs, ops = _vectors(list(there["vector"]), kind), there["first_op"].to_numpy()
                tails = there["tail"].to_numpy()
                for at in range(0, len(here), 256):
                    some = here.iloc[at : at + 256]
                    mine = _vectors(list(some["vector"]), kind)
                    d2 = np.rint((mine**2).sum(axis=1)[:, None] - 2 * mine @ theirs.T + (theirs**2).sum(axis=1)[None])
                    same = (d2 == 0) & (some["tail"].to_numpy()[:, None] == tails[None])
                    d2 = np.where(same | (ops[None] >= some["op_id"].to_numpy()[:, None]), np.inf, d2)
                    least = d2.min(axis=1)
                    first = np.where(d2 == least[:, None], ops[None], np.iinfo(np.int64).max).min(axis=1)
                    for i in np.flatnonzero(np.isfinite(least)):
                        for column, value in zip(out.values(), (int(some["op_id"].iat[i]), kind, int(first[i]), float(least[i])), strict=True):
                            column.append(value)
            return pd.DataFrame(out).astype({"op_id": "int64", "kind": "int32", "near_op": "int64", "distance2": "float64"})

        found = left.groupBy("probed", "block").cogroup(members.groupBy("probed", "block")).applyInPandas(compare, "op_id long, kind int, near_op long, distance2 double")
        return found.groupBy("op_id", "kind").agg(F.min(F.struct("distance2", "near_op")).alias("b")).select("op_id", "kind", F.col("b.near_op").alias("near_op"), F.col("b.distance2").alias("distance2"))


def _hash_signature() -> Column:
    """Struct (kind, sig) of hash_sig or brief_sig, null where both are."""
    pair = lambda kind, sig: F.struct(F.lit(kind).alias("kind"), F.col(sig).alias("sig"))
    return F.when(F.col("hash_sig").isNotNull(), pair(HASH, "hash_sig")).when(F.col("brief_sig").isNotNull(), pair(BRIEF, "brief_sig"))


def file_signatures(ops: DataFrame, groups: DataFrame) -> DataFrame:
    """(op_id, batch_id, kind, sig) of operations (op_id, batch_id, source, content_hash): the path's signature, and the hash's where it says something.

    For an operation whose own hash says nothing, ``groups`` (content_hash,
    original, duplicates) supplies the hash recorded for its path.
    """
    own_hash = [normal_hash(F.col("content_hash")).alias("hash_sig"), brief_hash(F.col("content_hash")).alias("brief_sig")]
    signed = with_signatures(ops.select("op_id", "batch_id", "source", *own_hash))
    by_path = F.when(F.col("path_sig").isNotNull(), F.struct(F.lit(PATH).alias("kind"), F.col("path_sig").alias("sig")))
    lacking = F.when(_hash_signature().isNull() & F.col("path_sig").isNotNull(), F.struct(F.lit(LACKING).alias("kind"), F.col("path_sig").alias("sig")))
    signed = signed.select("op_id", "batch_id", F.explode(F.array_compact(F.array(by_path, _hash_signature(), lacking))).alias("s")).select("op_id", "batch_id", "s.*")
    signed = materialise(signed, "signed")  # read for the history, for each batch, and for what lacks a hash
    paths = F.array_compact(F.array_distinct(F.concat(F.array("original"), F.coalesce("duplicates", F.array().cast("array<string>")))))
    listed = groups.select(*own_hash, F.explode(paths).alias("source")).where("hash_sig is not null or brief_sig is not null")
    # a path recorded with several hashes stands for each of them
    recorded = with_signatures(listed).where("path_sig is not null").groupBy(F.col("path_sig").alias("sig")).agg(F.collect_set(_hash_signature()).alias("hashes"))
    lack = signed.where(F.col("kind") == LACKING).select("op_id", "batch_id", "sig")
    weights = lack.groupBy("sig").agg(F.count(F.lit(1)).alias("n_rows"))
    supplied = skewed_lookup(lack, recorded.join(weights, "sig"), ["sig"], "n_rows")
    supplied = materialise(supplied.select("op_id", "batch_id", F.explode("hashes").alias("s")).select("op_id", "batch_id", "s.*"), "supplied")
    return signed.where(F.col("kind") != LACKING).unionByName(supplied)


def entries_of(signatures: DataFrame) -> DataFrame:
    """One entry per signature: the first operation that has it, and how many rows do."""
    return signatures.groupBy("kind", "sig").agg(F.min("op_id").alias("first_op"), F.count(F.lit(1)).alias("n_ops"))


def accept_batch(index: CellIndex, signatures: DataFrame) -> DataFrame:
    """(accepted_op_id, op_id): operations of the batch whose file an operation with a smaller op_id, in the index or the batch, has too.

    The batch is appended to the index first, so that copies within it meet as
    well; entries of the history are probed cell by cell and not written again.
    """
    fresh = index.append(entries_of(signatures))
    # a signature that one row has and no earlier operation leads to nothing
    found = index.probe(fresh).where("found_op < first_op or n_ops > 1")
    found = materialise(found.select("kind", F.concat("vector", "tail").alias("sig"), "n_ops", "found_op"), "found")
    pairs = skewed_lookup(signatures, found, ["kind", "sig"], "n_ops")
    return (
        pairs.groupBy("op_id").agg(F.min("found_op").alias("accepted_op_id")).where("accepted_op_id < op_id").select("accepted_op_id", "op_id")
    )


def deduplicate(ops: DataFrame, batches: DataFrame, groups: DataFrame, step: int | None = None, folder: str | None = None) -> DataFrame:
    """(accepted_op_id, op_id) for every operation of a ``new`` batch whose file came with a smaller op_id.

    ``ops`` has op_id, batch_id, source, content_hash; a row delivered again
    changes nothing, and if deliveries of an op_id differ each of them counts.
    Batches that are not new (an unknown batch too) are the history the index is
    built from; the new ones are accepted in order of batch_id, ``step`` at a time
    (default: in one delivery, which gives the same pairs, for the smallest op_id
    wins whatever the order of delivery). Null hashes and paths say nothing; an
    operation with neither has no duplicates. Empty tables give no rows.

    Without ``folder`` a run starts from the full history. With it, the index
    stays there: the first run builds it, a later one opens it and reads only the
    operations of new batches, so all other batches must have been accepted into
    it before. A hash ``groups`` records later does not reach back to entries
    that were accepted without one.
    """
    new = sorted(r[0] for r in batches.where("status = 'new' and batch_id is not null").select("batch_id").distinct().collect())
    fresh = F.coalesce(F.col("batch_id").isin(new), F.lit(False)) if new else F.lit(False)
    index = CellIndex.open(ops.sparkSession, folder) if folder else None
    sigs = file_signatures(ops.where("op_id is not null" if index is None else fresh & F.col("op_id").isNotNull()), groups)
    if index is None:
        index = CellIndex.build(entries_of(sigs.where(~fresh)), sigs.where(~fresh), folder)
    found = []
    size = step or max(1, len(new))
    for at in range(0, len(new), size):
        found.append(accept_batch(index, sigs.where(F.col("batch_id").isin(new[at : at + size])).select("op_id", "kind", "sig")))
    if not found:
        return ops.sparkSession.createDataFrame([], "accepted_op_id long, op_id long")
    return reduce(DataFrame.unionByName, found)


def near_files(ops: DataFrame, radius: float = 4.0, every: int = 50) -> DataFrame:
    """(op_id, near_op_id, distance2): for each operation whose op_id ``every`` divides, the nearest other path that an earlier operation has, within ``radius``.

    ``ops`` has op_id and source; all rows are searched. distance2 is the squared
    distance of the trigram counts, a whole number. A spelling of the same path is
    no other path. Operations with a null or blank path, and those with nothing
    within the radius, have no row; equally near ones give the smallest op_id.
    """
    named = ops.select("op_id", "source").where("op_id is not null")
    signed = materialise(with_signatures(named).where("path_sig is not null").select("op_id", F.lit(PATH).alias("kind"), F.col("path_sig").alias("sig")), "signed")
    index = CellIndex.build(entries_of(signed), signed)
    asked = signed.where(F.col("op_id") % every == 0).distinct()
    split = asked.select("op_id", "kind", F.substring("sig", 1, DIMS).alias("vector"), F.expr(f"substring(sig, {DIMS + 1})").alias("tail"))
    return index.nearest(split, radius).select("op_id", F.col("near_op").alias("near_op_id"), F.col("distance2").cast("long").alias("distance2"))
