"""Best-fit decreasing packing of documents onto sheets of fixed capacity.

The packing itself runs over the histogram of sizes, which has at most
capacity + 1 entries however large the corpus: items of one size are alike, and
so are sheets with the same room left. A segment tree over the remaining room
finds the tightest open sheets in logarithmic time, and a whole class of items
goes into a whole class of sheets at once, which gives exactly the packing that
best-fit decreasing would give item by item. Documents then look up their sheet
by size and rank within it; ranks are counted per salt, so that a size that a
third of all documents share is spread over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Items that share a salt, about: the salts of a size grow with the corpus.
ITEMS_PER_SALT, LEAST_SALTS = 100_000, 16


class RoomTree:
    """Segment tree over the room left, 0..capacity: which amounts have open sheets."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.open = bytearray(2 * self.width)

    def set(self, room: int, value: bool) -> None:
        at = room + self.width
        self.open[at] = value
        while at > 1:
            at >>= 1
            self.open[at] = self.open[2 * at] | self.open[2 * at + 1]

    def tightest(self, least: int) -> int:
        """The smallest room of at least ``least`` with an open sheet, or -1."""
        at = least + self.width
        if self.open[at]:
            return least
        while at > 1:
            if not at & 1 and self.open[at + 1]:
                at += 1
                while at < self.width:
                    at = 2 * at if self.open[2 * at] else 2 * at + 1
                return at - self.width
            at >>= 1
        return -1


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Best-fit decreasing over sizes 0..capacity.

    Returns segments (size, first rank, first sheet, items a sheet): the item of
    that size with rank r >= first rank (up to the next segment's) is on sheet
    first sheet + (r - first rank) // items a sheet; and the number of sheets.
    """
    tree = RoomTree(capacity)
    rooms: dict[int, list[tuple[int, int]]] = {}  # room left: ranges of sheets (first, count)
    out, sheets = [], 0

    def put(room: int, first: int, count: int) -> None:
        if room not in rooms:
            rooms[room] = []
            tree.set(room, True)
        rooms[room].append((first, count))

    for size in sorted((s for s, n in counts.items() if n > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                each = capacity // size if size else left
                full = left // each
                first, count, room = sheets, full + (left % each > 0), capacity
                sheets += count
            else:
                first, count = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    tree.set(room, False)
                each = room // size if size else left
                full = min(count, left // each)
            out.append((size, rank, first, each))
            if full:
                put(room - each * size, first, full)
                rank, left, first, count = rank + full * each, left - full * each, first + full, count - full
            if left and count:  # fewer items than the sheet could take
                put(room - left * size, first, 1)
                rank, left, first, count = rank + left, 0, first + 1, count - 1
            if count:
                put(room, first, count)
    return out, sheets


def pack_documents(sizes: DataFrame, capacity: int, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """(doc_id, piece, tokens, sheet): where each document, or piece of one, lies; sheets count from 0.

    A document larger than ``capacity`` is cut into full pieces and a rest; no
    other is cut. One of no tokens takes no room and lies on an existing sheet
    (on sheet 0 if there is no other document). Null sizes count as 0, negative
    ones as 0; rows with a null id are left out. Equal sizes are ranked by
    document, so the result is the same each time. ``capacity`` must be positive.
    """
    if capacity <= 0:
        raise ValueError("capacity must be positive")
    spark = sizes.sparkSession
    salts = max(LEAST_SALTS, sizes.count() // ITEMS_PER_SALT)
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    docs = sizes.select(F.col(key).cast("long").alias(key), n.alias("n")).where(F.col(key).isNotNull())
    last = F.greatest(F.expr(f"(n + {capacity} - 1) div {capacity}") - 1, F.lit(0))
    items = docs.select(key, "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece")).select(
        key, "piece", F.least(F.col("n") - F.col("piece") * capacity, F.lit(capacity)).cast("long").alias("tokens")
    ).withColumn("salt", F.pmod(F.xxhash64(key, "piece"), F.lit(salts)).cast("int"))
    per_salt = items.groupBy("tokens", "salt").agg(F.count(F.lit(1)).alias("here"))
    histogram = {r[0]: r[1] for r in per_salt.groupBy("tokens").agg(F.sum("here")).collect()}  # at most capacity + 1 rows
    segments, _ = pack_histogram(histogram, capacity)
    by_salt = Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_salt.select("tokens", "salt", F.coalesce(F.sum("here").over(by_salt), F.lit(0)).alias("before"))
    order = Window.partitionBy("tokens", "salt").orderBy(key, "piece")
    ranked = items.withColumn("in_salt", F.row_number().over(order).cast("long") - 1).join(offsets, ["tokens", "salt"])
    ranked = ranked.select(key, "piece", "tokens", (F.col("before") + F.col("in_salt")).alias("rank"))
    table = np.array(segments, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    shared = spark.sparkContext.broadcast(table)  # its length depends on the capacity, not on the corpus

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = shared.value
        sizes_at, ranks_at = seg[:, 0].copy(), seg[:, 1].copy()
        starts = {int(s): i for s, i in zip(*np.unique(sizes_at, return_index=True), strict=True)}
        ends = {int(s): i + n for s, i, n in zip(*np.unique(sizes_at, return_index=True, return_counts=True), strict=True)}
        for batch in batches:
            tokens, rank = np.asarray(batch.column(2)), np.asarray(batch.column(3))
            at = np.zeros(len(tokens), np.int64)
            for s in np.unique(tokens):
                mine = tokens == s
                lo, hi = starts[int(s)], ends[int(s)]
                at[mine] = lo + np.searchsorted(ranks_at[lo:hi], rank[mine], side="right") - 1
            sheet = seg[at, 2] + (rank - seg[at, 1]) // np.maximum(seg[at, 3], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(sheet)], names=[key, "piece", "tokens", "sheet"])

    return ranked.mapInArrow(place, f"`{key}` long, piece long, tokens long, sheet long")
