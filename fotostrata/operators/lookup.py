"""Joining many rows to a table by keys of which some may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: At most so many keys are broadcast, whatever the data's size.
HOT_KEYS = 1_000


def skewed_lookup(rows: DataFrame, keyed: DataFrame, on: list[str], weight: str, hot_keys: int = HOT_KEYS) -> DataFrame:
    """Inner join of ``rows`` to ``keyed`` (unique by ``on``), of whose keys ``weight`` rows each are expected.

    The ``hot_keys`` heaviest keys are joined by a broadcast of bounded length,
    so their rows stay where they are; the others, none of which can hold more
    than one part in ``hot_keys`` of the rows, by a shuffled join. Rows with a
    null in ``on`` match nothing. ``weight`` is not in the result.
    """
    hot = keyed.orderBy(F.desc(weight), *on).limit(hot_keys).drop(weight)
    values = [c for c in keyed.columns if c not in (*on, weight)]
    marked = hot.select(*on, F.struct(*values).alias("_hot"))
    seen = rows.join(F.broadcast(marked), on, "left")
    heavy = seen.where("_hot is not null").select(*rows.columns, "_hot.*")
    light = seen.where("_hot is null").select(*rows.columns).join(keyed.drop(weight), on)
    return heavy.unionByName(light.select(*rows.columns, *values))
