"""Path and key normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earmark.constants import CLIP_MARKER, SOURCE_PREFIX, WHITESPACE


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: Column | str) -> Column:
    """Drop white space at both ends, line breaks and ideographic spaces included."""
    return F.btrim(as_col(value), F.lit(WHITESPACE))


def blank_to_null(value: Column | str) -> Column:
    return F.nullif(strip(value), F.lit(""))


def norm_path(value: Column | str) -> Column:
    return F.translate(strip(value), "\\", "/")


def source_key(value: Column | str, prefix: str = SOURCE_PREFIX) -> Column:
    """Key of an item relative to its store: leading dots and slashes go, then the store prefix."""
    path = F.ltrim(norm_path(value), F.lit("./"))
    return F.when(F.startswith(path, F.lit(prefix)), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def basename(value: Column | str) -> Column:
    return F.substring_index(F.rtrim(norm_path(value), F.lit("/")), "/", -1)


def resolve_path(value: Column | str, root: str, staged_root: str | None = None, staged_marker: str = "music_db_15s") -> Column:
    """Absolute key of a project path, by text alone; clips may live below a staging root instead."""
    path = as_col(value)
    absolute = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))
    absolute = F.regexp_replace(absolute, r"/(?:\./|/)+", "/")
    if staged_root is None:
        return absolute
    staged = F.concat(F.lit(staged_root.rstrip("/") + "/"), basename(path))
    return F.when(F.contains(norm_path(path), F.lit(staged_marker)), staged).otherwise(absolute)


def cache_key(value: Column | str, marker: str = CLIP_MARKER) -> Column:
    """What follows the first store marker, or the whole path where the marker is absent."""
    path = norm_path(value)
    at = F.locate(marker, path)
    return F.when(at > 0, F.substring(path, at + len(marker), F.lit(1 << 30))).otherwise(path)


def blob_name(key: Column | str) -> Column:
    """Stable file name of a cached feature: key digest plus the readable end of the key."""
    key = as_col(key)
    readable = F.replace(key, F.lit("/"), F.lit("__"))
    return F.concat(F.substring(F.sha2(key, 256), 1, 20), F.lit("_"), F.right(readable, F.lit(80)), F.lit(".npy"))


def drop_extension(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), r"\.[^.]*$", "")


def safe_stem(value: Column | str) -> Column:
    """Relative path without its suffix, directories joined by a double underscore."""
    stem = F.regexp_replace(norm_path(value), r"([^/])\.[^./]+$", "$1")
    return F.replace(stem, F.lit("/"), F.lit("__"))


def clip_name(value: Column | str, index: Column | str) -> Column:
    return F.format_string("%s__seg%03d.mp3", safe_stem(value), as_col(index).cast("int"))


def file_suffix(value: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(basename(value), r"^.+(\.[^.]+)$", 1))
    return F.when(suffix == "", F.lit("<no extension>")).otherwise(suffix)


def seeded_hash(seed: int, key: Column | str) -> Column:
    """Hex digest that orders keys pseudo-randomly, the same on any partitioning. A null key has a digest, too."""
    text = F.coalesce(as_col(key).cast("string"), F.lit("\0"))
    return F.md5(F.concat(F.lit(f"{seed}:"), text).cast("binary"))
