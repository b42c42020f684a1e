"""Parts of paths as built-in columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The image formats and their extensions; RAW formats with their flow.
FORMATS = {
    "JPEG": (".jpg", ".jpeg"), "PNG": (".png",), "TIFF": (".tif", ".tiff"), "WEBP": (".webp",), "BMP": (".bmp",), "HEIF": (".heic", ".heif", ".hif"),
}
NO_EXIF = ("WEBP", "BMP")
RAW_FORMATS = {
    ".dng": "Apple ProRAW", ".cr2": "Canon RAW", ".cr3": "Canon RAW", ".crw": "Canon RAW", ".nef": "Nikon RAW", ".arw": "Sony RAW", ".rw2": "Panasonic RAW",
    ".orf": "Olympus/OM System RAW", ".raf": "Fujifilm RAW",
}
RAW_FLOWS = {".dng": "Apple ProRAW / Linear DNG"}


def name(path: Column) -> Column:
    # the expression tries every position, so only paths that end in a slash need it
    return F.when(path.endswith("/"), F.regexp_extract(path, r"([^/]*)/*$", 1)).otherwise(F.substring_index(path, "/", -1))


def parent(path: Column) -> Column:
    before = F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)))
    return F.when(path.endswith("/"), F.regexp_extract(path, r"^(.*?)/+[^/]*/*$", 1)).otherwise(F.rtrim(before, F.lit("/")))


def suffix(path: Column) -> Column:
    """The last extension with its dot and case; "" for none and for names that only begin with a dot."""
    return F.regexp_extract(name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    n = name(path)
    return F.when(suffix(path) == "", n).otherwise(F.substring(n, F.lit(1), F.length(n) - F.length(suffix(path))))


def extension(path: Column) -> Column:
    return F.lower(suffix(path))


def _looked_up(ext: Column, table: dict[str, str]) -> Column:
    out = F.lit("")
    for key, value in table.items():
        out = F.when(ext == key, F.lit(value)).otherwise(out)
    return out


def format_name(ext: Column) -> Column:
    """Format of a lower-case extension, "" if unknown."""
    return _looked_up(ext, {**RAW_FORMATS, **{e: fmt for fmt, exts in FORMATS.items() for e in exts}})


def raw_format(ext: Column) -> Column:
    return _looked_up(ext, RAW_FORMATS)


def raw_flow(ext: Column) -> Column:
    return _looked_up(ext, RAW_FLOWS)


def is_raw(ext: Column) -> Column:
    return ext.isin(*RAW_FORMATS)


def is_supported(ext: Column) -> Column:
    return ext.isin(*RAW_FORMATS, *[e for exts in FORMATS.values() for e in exts])
