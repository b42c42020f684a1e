"""Gap sessions by occupancy bitmaps.

Each entity's events become bits of a bitmap whose bit is a fraction of the
smallest gap wide. A morphological closing as long as the gap joins bits that
belong together for certain; the runs of the closed bitmap are cut out, joined
with the event counts, trimmed to the first and last event inside, and runs
whose distance lies within one bit of the gap are decided by those exact times.

Scale: events are pre-aggregated to bits before the shuffle, a bitmap covers a
fixed span of time, and runs of one entity lie more than a gap apart, so what a
task holds is bounded by time over gap and never by the number of events.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BITS_PER_GAP = 32
CHUNK_BITS = 4096


def close_bitmap(bits: int, reach: int) -> int:
    """Morphological closing with a segment of ``reach`` + 1 bits, by doubling shifts.

    Two set bits i < j end up joined exactly if some chain of set bits between
    them has steps of at most ``reach`` + 1.
    """
    grown, done, step = bits, 0, 1
    while done < reach:
        step = min(step, reach - done)
        grown |= grown << step
        done += step
        step = done + 1
    shrunk, done, step = grown, 0, 1
    while done < reach:
        step = min(step, reach - done)
        shrunk &= shrunk >> step
        done += step
        step = done + 1
    return shrunk | bits


def bitmap_runs(bits: int) -> list[tuple[int, int]]:
    """First and last position of each run of set bits, in order."""
    runs = []
    while bits:
        start = (bits & -bits).bit_length() - 1
        rest = ~(bits >> start)
        length = (rest & -rest).bit_length() - 1
        runs.append((start, start + length - 1))
        bits &= ~(((1 << length) - 1) << start)
    return runs


def _chunk_runs(bit, n, first, last, gap, bit_us: int) -> list[tuple[int, int, int, int]]:
    """Runs of one bitmap as (first, last, n, gap of the first event)."""
    order = np.argsort(bit, kind="stable")
    bit, n, first, last, gap = (x[order] for x in (bit, n, first, last, gap))
    bitmap = 0
    for b in bit.tolist():
        bitmap |= 1 << b
    reach = int(gap.min()) // bit_us - 2
    out: list[list[int]] = []
    for lo, hi in bitmap_runs(close_bitmap(bitmap, reach)) if reach >= 0 else [(b, b) for b in bit.tolist()]:
        i, j = np.searchsorted(bit, [lo, hi + 1])
        run = [int(first[i]), int(last[j - 1]), int(n[i:j].sum()), int(gap[i])]
        if out and run[0] - out[-1][1] <= run[3]:
            out[-1][1], out[-1][2] = run[1], out[-1][2] + run[2]
        else:
            out.append(run)
    return [tuple(r) for r in out]


def gap_sessions(
    events: DataFrame, entity: str, at_us: str, gap_us: str, least_gap_us: int
) -> DataFrame:
    """Sessions of ``events``: (entity, start_us, end_us, duration_us, n_events).

    A session of an entity ends where the distance to the next event is greater
    than that event's ``gap_us``; an equal distance still belongs to it.
    ``least_gap_us`` is a lower bound of ``gap_us``; a smaller gap raises an error
    rather than giving a wrong session.

    Rows with a null entity, time or gap take part in no session; a gap of zero
    separates any two different times (a negative one counts as zero); equal
    times always share a session; repeated rows are counted as they come. An
    empty input gives no rows. Columns other than the three named are ignored,
    whatever their names.
    """
    least = max(0, int(least_gap_us))
    bit_us = max(1, least // BITS_PER_GAP)
    cells = (
        events.select(
            F.col(entity).cast("string").alias("entity"),
            F.col(at_us).cast("long").alias("at"),
            F.when(F.col(gap_us).isNotNull(), F.greatest(F.col(gap_us).cast("long"), F.lit(0))).alias("gap"),
        )
        .where("entity is not null and at is not null and gap is not null")
        .withColumn("gap", F.when(F.col("gap") >= least, F.col("gap")).otherwise(F.raise_error(F.lit("gap below least_gap_us"))))
        .withColumn("cell", F.expr(f"(at - pmod(at, {bit_us}L)) div {bit_us}L"))
        .groupBy("entity", "cell")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.min("at").alias("first"),
            F.max("at").alias("last"),
            F.min_by("gap", F.struct("at", "gap")).alias("gap"),
        )
    )
    chunked = (
        cells.withColumn("chunk", F.expr(f"(cell - pmod(cell, {CHUNK_BITS}L)) div {CHUNK_BITS}L"))
        .withColumn("bit", F.expr(f"cast(pmod(cell, {CHUNK_BITS}L) as int)"))
        .groupBy("entity", "chunk")
        .agg(F.collect_list(F.struct("bit", "n", "first", "last", "gap")).alias("bits"))
        .select("entity", "bits")
    )

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lists = batch.column(0), batch.column(1)
            offsets = lists.offsets.to_numpy()
            base = int(offsets[0]) if len(offsets) else 0
            flat = lists.flatten()
            cols = [np.asarray(flat.field(k)) for k in range(5)]
            who: list[int] = []
            got: list[tuple[int, int, int, int]] = []
            for i in range(len(names)):
                part = slice(int(offsets[i]) - base, int(offsets[i + 1]) - base)
                found = _chunk_runs(*(c[part] for c in cols), bit_us)
                got += found
                who += [i] * len(found)
            values = np.array(got, dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [names.take(pa.array(who, pa.int64())), *(pa.array(values[:, k]) for k in (0, 1, 2, 3))],
                names=["entity", "first", "last", "n", "gap"],
            )

    pieces = chunked.mapInArrow(runs, "entity string, first long, last long, n long, gap long")
    order = Window.partitionBy("entity").orderBy("first", "last")
    return (
        pieces.withColumn("before", F.lag("last").over(order))
        .withColumn("opens", (F.col("before").isNull() | (F.col("first") - F.col("before") > F.col("gap"))).cast("int"))
        .withColumn("session", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("entity", "session")
        .agg(F.min("first").alias("start_us"), F.max("last").alias("end_us"), F.sum("n").alias("n_events"))
        .select(
            F.col("entity").alias(entity),
            "start_us",
            "end_us",
            (F.col("end_us") - F.col("start_us")).alias("duration_us"),
            "n_events",
        )
    )
