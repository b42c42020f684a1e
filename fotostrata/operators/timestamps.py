"""Mixed timestamp notations to one UTC instant.

An ordered cascade of anchored patterns turns a value into fields; the first
pattern that matches the whole value wins, and the fields are checked strictly
(no 31 February, no hour 24). The zone is the one written in the value, else a
default per row. Everything is built-in column expressions: no shuffle, no
Python workers.

Policy for local times: a wall time that occurs twice is the first of the two;
one that is skipped is read with the offset in force before the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The notations of dates, times and zones.
_ZONE = r"(?:\s*(Z|(?:UTC|GMT)?[+\-−]\d{1,2}(?::?\d{2})?|UTC|GMT))?"
_FRACTION = r"(?:[.,](\d{1,12}))?"
_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_MONTH = r"(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\.?"
_HALF = r"\s*([ap])\.?m\.?"

#: (name, pattern, which group is year, month, day, hour, minute, second, fraction, half of day, zone); 0 is none.
CASCADE = [
    ("ymd", r"(\d{4})[:\-](\d{1,2})[:\-](\d{1,2})[T\s]\s*(\d{1,2}):(\d{2})(?::(\d{2})" + _FRACTION + ")?" + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("ymd_half", r"(\d{4})[/:\-](\d{1,2})[/:\-](\d{1,2})[T\s]\s*(\d{1,2}):(\d{2})(?::(\d{2})" + _FRACTION + ")?" + _HALF + _ZONE, (1, 2, 3, 4, 5, 6, 7, 8, 9)),
    ("ymd_slash", r"(\d{4})[/.](\d{1,2})[/.](\d{1,2})[T\s]\s*(\d{1,2}):(\d{2})(?::(\d{2})" + _FRACTION + ")?" + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("mail", r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?(\d{1,2})\s+" + _MONTH + r"\s+(\d{4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2})" + _FRACTION + ")?" + _ZONE, (3, 2, 1, 4, 5, 6, 7, 0, 8)),
    ("compact", r"(\d{4})(\d{2})(\d{2})[T\s]?(\d{2})(\d{2})(\d{2})" + _FRACTION + _ZONE, (1, 2, 3, 4, 5, 6, 7, 0, 8)),
    ("dmy", r"(\d{1,2})([./])(\d{1,2})\2(\d{4})[T\s]\s*(\d{1,2}):(\d{2})(?::(\d{2})" + _FRACTION + ")?" + _ZONE, (4, 3, 1, 5, 6, 7, 8, 0, 9)),
    ("long", _MONTH + r"\s+(\d{1,2}),?\s+(\d{4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2})" + _FRACTION + ")?" + _HALF + _ZONE, (3, 1, 2, 4, 5, 6, 7, 8, 9)),
    ("long_24", _MONTH + r"\s+(\d{1,2}),?\s+(\d{4}),?\s+(\d{1,2}):(\d{2})(?::(\d{2})" + _FRACTION + ")?" + _ZONE, (3, 1, 2, 4, 5, 6, 7, 0, 8)),
]
#: Digits of a number since 1970 and what to multiply it by for microseconds; fourteen digits are a compact date.
EPOCHS = {10: 1_000_000, 13: 1_000, 16: 1}
_MARK = "\u001f"


def bare_value(value: Column) -> Column:
    """The value without a JSON list or object, a language mark, NULs and outer blanks."""
    inner = F.regexp_replace(F.regexp_replace(value, r"\u0000", ""), r"\\u2212", "−")
    inner = F.regexp_replace(inner, r'^\s*(?:\[\s*"|\{\s*"[^"]*"\s*:\s*"|lang="[^"]*"\s+)', "")
    inner = F.regexp_replace(inner, r'"\s*[\]}]\s*$', "")
    return F.regexp_replace(inner, r"^[\s ]+|[\s ]+$", "")


def offset_seconds(text: Column) -> Column:
    """Seconds east of UTC of a written offset (Z, UTC+5:30, -0300, −05:00, GMT); null if it is none."""
    plain = F.upper(F.regexp_replace(F.trim(text), "−", "-"))
    shape = r"^(?:UTC|GMT)?([+\-])(\d{1,2})(?::?(\d{2}))?$"
    hours = F.regexp_extract(plain, shape, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(plain, shape, 3).try_cast("int"), F.lit(0))
    sign = F.when(F.regexp_extract(plain, shape, 1) == "-", -1).otherwise(1)
    return F.when(plain.isin("Z", "UTC", "GMT"), F.lit(0)).when(
        plain.rlike(shape) & (minutes < 60) & (hours * 60 + minutes <= 18 * 60), sign * (hours * 60 + minutes) * 60
    )


def clock_offset_seconds(text: Column) -> Column:
    """Seconds of a clock offset: [+-]Nd, [+-]Nh, [+-]HH, [+-]HH:MM, [+-]HHMM; null if it is none of them."""
    plain = F.regexp_replace(text, r"^\s+|\s+$", "")
    sign = F.when(plain.startswith("-"), -1).otherwise(1)
    number = lambda shape, k: F.regexp_extract(plain, shape, k).try_cast("long")
    # fixed values: the notations of clock offsets
    days, hours, clock = r"^[+-]?(\d{1,3})[dD]$", r"^[+-]?(\d{1,4})[hH]$", r"^[+-]?(\d{1,2})(?::?(\d{2}))?$"
    h, m = number(clock, 1), F.coalesce(number(clock, 2), F.lit(0))
    return (
        F.when(plain.rlike(days), sign * number(days, 1) * 86400)
        .when(plain.rlike(hours), sign * number(hours, 1) * 3600)
        .when(plain.rlike(clock) & (h <= 23) & (m <= 59), sign * (h * 60 + m) * 60)
    )


def zone_table(spark: SparkSession) -> DataFrame:
    """(zone_key, zone_id): every region the JVM's zone rules know, by lower-case name with _ for blanks.

    About 600 rows whatever the data, hence safe to broadcast.
    """
    ids = sorted(str(x) for x in spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    regions = [(x.lower(), x) for x in ids if "/" in x and not x.startswith(("SystemV/", "Etc/"))]
    return spark.createDataFrame(regions, "zone_key string, zone_id string")


def zone_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+", "_"))


def parse_fields(value: Column) -> Column:
    """Canonical text year|month|day|hour|minute|second|fraction|half|zone of the first pattern that matches whole; else null."""
    out = F.lit(None).cast("string")
    for _, pattern, groups in reversed(CASCADE):
        anchored = "(?i)^" + pattern + "$"
        canon = F.regexp_replace(value, anchored, _MARK.join(f"${g}" if g else "" for g in groups))
        out = F.when(value.rlike(anchored), canon).otherwise(out)
    return out


def _with_local_micros(df: DataFrame, parts: str, tmp: str) -> DataFrame:
    """Adds ``tmp``civil: microseconds of the wall time since 1970-01-01 on the same clock, null if the fields are no real time.

    In steps of small projections: one large expression would outgrow code generation.
    """
    get = lambda k: F.try_element_at(F.col(parts), F.lit(k + 1))
    col = lambda x: F.col(tmp + x)
    df = df.withColumns({
        f"{tmp}y": get(0).try_cast("int"),
        f"{tmp}name": F.lower(F.substring(get(1), 1, 3)),
        f"{tmp}d": get(2).try_cast("int"),
        f"{tmp}h": get(3).try_cast("int"),
        f"{tmp}mi": get(4).try_cast("int"),
        f"{tmp}s": F.coalesce(F.nullif(get(5), F.lit("")), F.lit("0")).try_cast("int"),
        f"{tmp}us": F.rpad(F.substring(F.coalesce(get(6), F.lit("")), 1, 6), 6, "0").try_cast("long"),
        f"{tmp}half": F.lower(get(7)),
    })
    named = F.expr(f"(locate({tmp}name, '{''.join(_MONTHS)}') + 2) div 3").cast("int")
    df = df.withColumns({
        f"{tmp}mo": F.when(col("name").rlike("^[a-z]{3}$"), named).otherwise(col("name").try_cast("int")),
        f"{tmp}h": F.when(col("half") == "", col("h")).when(col("h").between(1, 12), col("h") % 12 + F.when(col("half") == "p", 12).otherwise(0)),
    })
    midnight = F.try_make_timestamp_ntz(col("y"), col("mo"), col("d"), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
    df = df.withColumn(f"{tmp}day", F.unix_date(F.to_date(midnight)).cast("long"))
    fits = (col("y") > 0) & col("h").between(0, 23) & col("mi").between(0, 59) & col("s").between(0, 59)
    clock = ((col("day") * 24 + col("h")) * 60 + col("mi")) * 60_000_000 + col("s").cast("long") * 1_000_000 + col("us")
    return df.withColumn(f"{tmp}civil", F.when(fits, clock))


def to_utc(df: DataFrame, value: str, default_zone: str | None = None, clock_offset: str | None = None, out: str = "utc_us") -> DataFrame:
    """``df`` with ``out``: microseconds since 1970-01-01 UTC of the time in column ``value``.

    Null where the value is null, blank, no date with a time of day, no real
    date or time, or of no known zone. A number since 1970 of 10, 13 or 16
    digits is UTC. ``default_zone`` names a column with zone names or offsets for
    values without their own (null, blank and meaningless ones give no zone);
    ``clock_offset`` names one whose offset is added to the wall time first (an
    invalid one adds nothing). Missing seconds are 0 and digits beyond
    microseconds are cut off. Rows are neither dropped nor repeated; all other
    columns stay as they are.
    """
    spark = df.sparkSession
    tmp = "_ts_"  # working columns; names that the input has itself are kept by working on a struct
    base = df.select(F.struct("*").alias(f"{tmp}row"), F.col(value).cast("string").alias(f"{tmp}raw"),
                     (F.col(default_zone).cast("string") if default_zone else F.lit(None).cast("string")).alias(f"{tmp}zone"),
                     (F.col(clock_offset).cast("string") if clock_offset else F.lit(None).cast("string")).alias(f"{tmp}shift"))
    col = lambda x: F.col(tmp + x)
    base = base.withColumn(f"{tmp}bare", bare_value(col("raw")))
    base = base.withColumn(f"{tmp}parts", F.split(parse_fields(col("bare")), _MARK))
    epoch = F.lit(None).cast("long")
    for digits, factor in EPOCHS.items():
        epoch = F.when(col("bare").rlike(rf"^\d{{{digits}}}$"), col("bare").try_cast("long") * factor).otherwise(epoch)
    base = _with_local_micros(base.withColumn(f"{tmp}epoch", epoch), f"{tmp}parts", tmp)
    base = base.withColumn(f"{tmp}local", F.coalesce(col("epoch"), col("civil")))
    written = F.try_element_at(col("parts"), F.lit(9))
    has_own = F.coalesce(written, F.lit("")) != ""
    base = base.withColumn(f"{tmp}own", F.when(col("epoch").isNotNull(), F.lit(0)).when(has_own, offset_seconds(written)))
    base = base.withColumn(f"{tmp}fixed", F.when(col("epoch").isNotNull() | has_own, col("own")).otherwise(offset_seconds(col("zone"))))
    # only rows that need a region look one up
    base = base.withColumn(f"{tmp}key", F.when(col("epoch").isNull() & ~has_own & col("fixed").isNull() & col("local").isNotNull(), zone_key(col("zone"))))
    shifted = col("local") + F.coalesce(clock_offset_seconds(col("shift")), F.lit(0)) * 1_000_000
    base = base.withColumn(f"{tmp}local", shifted)
    if default_zone:
        zones = zone_table(spark).select(F.col("zone_key").alias(f"{tmp}zone_key"), F.col("zone_id").alias(f"{tmp}zone_id"))
        base = base.join(F.broadcast(zones), col("key") == col("zone_key"), "left")
    else:
        base = base.withColumn(f"{tmp}zone_id", F.lit(None).cast("string"))
    region = F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(col("local")), F.coalesce(col("zone_id"), F.lit("UTC"))))
    utc = F.when(col("fixed").isNotNull(), col("local") - col("fixed").cast("long") * 1_000_000).when(col("zone_id").isNotNull(), region)
    return base.select(f"{tmp}row.*", utc.alias(out))
