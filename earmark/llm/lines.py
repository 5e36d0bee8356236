"""Removal of repeated runs of lines, found by winnowing over line hashes.

Lines are trimmed of spaces, tabs and returns; blank ones don't count and always stay. A run of ``RUN`` consecutive lines is
repeated if the same lines stand at an earlier place, in the order of id and then of position; so is a shorter run that has
``LONG`` words or more in all. Every line that is covered by such a later occurrence is removed; longer runs are covered by the runs of RUN
lines inside them, so matches extend both ways as far as they go.

Winnowing finds them without comparing all runs: of each window of RUN adjacent line hashes the least (the last of equals) is
a fingerprint. Two equal runs of RUN lines have the same least line, so both carry the same fingerprint at the same place.
Fingerprints that occur once are dropped; around each of the others only the runs that contain it are compared, each with the
first place at which it occurs, not with all others. Lines are compared by 64-bit hashes.

All of it is DataFrame functions. Minima by fingerprint and by run are partial aggregations, so a line that stands in a third
of all documents is no hot group; the joins that follow have unique keys on one side.

Defined results: null and empty texts keep their (no) lines; null ids come after all others; rows equal in id and text are one
document and get the same result; a run that repeats inside one document loses its later occurrences; very long texts and lines are
read whole; of equal minima in a window the last is the fingerprint; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.llm.common import WORD_PATTERN, pin

RUN = 3
LONG = 50
BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _trim(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANK))


def _range(low: Column | int, high: Column) -> Column:
    """low, low + 1, ..., high; empty if high is less."""
    low = F.lit(low) if isinstance(low, int) else low
    return F.when(high >= low, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """(id, tag, mark, at, n, runs): each fingerprint with the hashes of the runs of n lines, from line ``at`` on, that hold it.

    ``tag`` is the text's hash; lines are counted without blank ones.
    """
    lines = F.filter(F.transform(_lines(F.col(f"`{text}`")), _trim), lambda x: x != "")
    hashed = docs.select(
        F.col(f"`{key}`").alias("id"), F.xxhash64(F.col(f"`{text}`")).alias("tag"), F.transform(lines, lambda x: F.xxhash64(x)).alias("h"),
        F.transform(lines, lambda x: F.regexp_count(x, F.lit(WORD_PATTERN))).alias("words"))
    last = F.size("h") - run

    def least(i: Column) -> Column:
        window = F.slice("h", i + 1, run)
        return i + run - F.array_position(F.reverse(window), F.array_min(window)).cast("int")

    marks = F.array_distinct(F.transform(_range(0, last), least))
    runs = F.transform(marks, lambda p: F.struct(
        F.get("h", p).alias("mark"), F.greatest(p - (run - 1), F.lit(0)).alias("at"), F.lit(run).alias("n"),
        F.transform(_range(F.greatest(p - (run - 1), F.lit(0)), F.least(p, last)), lambda s: F.xxhash64(F.slice("h", s + 1, run))).alias("runs")))

    def by_words(n: int) -> Column:
        """Runs of n lines that are repeats for their words; such a run is its own fingerprint."""
        own = F.filter(_range(0, F.size("h") - n), lambda i: sum((F.get("words", i + k) for k in range(1, n)), F.get("words", i)) >= long)
        mark = lambda i: F.xxhash64(F.lit("words"), F.lit(n), F.slice("h", i + 1, n))
        return F.transform(own, lambda i: F.struct(mark(i).alias("mark"), i.alias("at"), F.lit(n).alias("n"), F.array(mark(i)).alias("runs")))

    shorter = [by_words(n) for n in range(1, run)]
    return hashed.select("id", "tag", F.explode(F.concat(runs, *shorter)).alias("x")).select("id", "tag", "x.*")


def removed_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """(id, tag, removed): the numbers, among lines that aren't blank, of the lines to remove; only documents with any."""
    if run < 1 or long < 1:
        raise ValueError("run and long must be 1 at least")
    found = pin(fingerprints(docs, key, text, run, long), "fingerprints")
    document = [F.col("id").isNull().alias("none"), F.coalesce("id", F.lit(0)).alias("id"), F.col("tag").alias("tag")]
    place = F.struct(*document, F.col("at").alias("at"))
    shared = found.groupBy("mark").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).select("mark")
    runs = found.join(shared, "mark", "left_semi").select("id", "tag", "n", "at", F.posexplode("runs").alias("step", "hash"))
    runs = runs.select("id", "tag", "n", (F.col("at") + F.col("step")).alias("at"), "hash")
    first = runs.groupBy("hash").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last"))
    later = runs.join(first, "hash").filter(place != F.col("first"))
    covered = F.flatten(F.collect_set(F.sequence(F.col("at"), F.col("at") + F.col("n") - 1)))
    return later.groupBy("id", "tag").agg(F.array_sort(F.array_distinct(covered)).alias("removed"))


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN, long: int = LONG) -> DataFrame:
    """One row per row of ``docs``: id, text without the repeated runs, n_lines (not blank) and n_removed."""
    removed = removed_lines(docs, key, text, run, long).withColumnsRenamed({"id": "r_id", "tag": "r_tag"})
    rows = docs.select(F.col(f"`{key}`").alias("id"), F.col(f"`{text}`").alias("text")).withColumn("tag", F.xxhash64("text"))
    joined = rows.join(removed, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("tag") == F.col("r_tag")), "left")
    lines = _lines(F.col("text"))
    numbers = F.filter(_range(0, F.size("lines") - 1), lambda i: _trim(F.get("lines", i)) != "")
    left = F.array_except(_range(0, F.size("lines") - 1), F.transform("removed", lambda p: F.get("numbers", p)))
    return joined.withColumn("lines", lines).withColumn("numbers", numbers).select(
        "id", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n")).alias("text"),
        F.size("numbers").alias("n_lines"), F.coalesce(F.size("removed"), F.lit(0)).alias("n_removed"))
