"""Sessions of a stream of captures, as an extension: event ids are start times, since ranks over all time cannot be streamed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_sessions(captures: DataFrame, entity: str, at: str, gap: str, watermark: str = "1 hour") -> DataFrame:
    """(entity, session_id, start, end, n_events) as sessions close; ``at`` is a timestamp, a gap equal to ``gap`` still belongs.

    session_window ends a session where the next event is at or after the gap's
    end; a microsecond is added, so that an equal gap joins as in the batch
    operator. Events later than the watermark are dropped by the engine's rules.
    """
    window = F.session_window(at, f"{gap} 1 microsecond")
    grouped = captures.where(F.col(entity).isNotNull() & F.col(at).isNotNull()).withWatermark(at, watermark).groupBy(entity, window.alias("w"))
    counted = grouped.agg(F.count(F.lit(1)).alias("n_events"), F.min(at).alias("start"), F.max(at).alias("end"))
    return counted.select(entity, F.date_format("start", "'event-'yyyyMMdd'T'HHmmss.SSSSSS").alias("session_id"), "start", "end", "n_events")
