"""Numeric and record coercion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from earmark.constants import PUBLIC_LABELS, TEMPO_BOUNDS, TEMPO_LABELS
from earmark.functions.keys import as_col, blank_to_null, strip


def clamp_unit(value: Column | str) -> Column:
    """Number limited to [0, 1]; text that is no number, and null, become 0."""
    return F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), as_col(value).try_cast("double"))), F.lit(0.0))


def quantise_confidence(value: Column | str, from_text: bool = True) -> Column:
    """Confidence as stored: limited to [0, 1] and rounded half-even to two decimals.

    Records hold numbers; with ``from_text`` false, text is no confidence and counts as 0 even if it reads as a number.
    """
    value = as_col(value)
    if not from_text:
        value = F.when(F.typeof(value) != "string", value.cast("string"))
    return F.bround(clamp_unit(value), 2)


def confidence_or_zero(value: Column | str) -> Column:
    return F.coalesce(as_col(value).try_cast("double"), F.lit(0.0))


def parse_flag(cell: Column | str) -> Column:
    """Integer of a label cell; blank and unreadable cells count as 0."""
    return F.coalesce(strip(cell).try_cast("double").try_cast("int"), F.lit(0))


def flag_is_bad(cell: Column | str) -> Column:
    """True where a label cell holds text that is no number."""
    return blank_to_null(cell).isNotNull() & strip(cell).try_cast("double").isNull()


def parse_relevance(cell: Column | str) -> Column:
    """Graded relevance; blank, unreadable and negative cells are unjudged (null)."""
    score = strip(cell).try_cast("double")
    return F.when(score >= 0, score)


def bin_value(value: Column | str, bounds: Sequence[float] = TEMPO_BOUNDS, labels: Sequence[str] = TEMPO_LABELS) -> Column:
    """First label below the first bound, then up to and including each next bound, last label above."""
    value = as_col(value)
    chain = F.when(value < bounds[0], F.lit(labels[0]))
    for bound, label in zip(bounds[1:], labels[1:], strict=False):
        chain = chain.when(value <= bound, F.lit(label))
    return F.when(value.isNotNull(), chain.otherwise(F.lit(labels[-1])))


def array_mean(values: Column | str) -> Column:
    """Mean of an array; null for an empty or null array."""
    values = as_col(values)
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(values) > 0, total / F.size(values))


def public_label_map(row_columns: Sequence[str] = tuple(PUBLIC_LABELS.values())) -> Column:
    """Label map of a public row, keyed by tag; a missing label is 0."""
    keys = F.array(*[F.lit(tag) for tag in PUBLIC_LABELS])
    values = F.array(*[F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in row_columns])
    return F.map_from_arrays(keys, values)


def tag_buckets(labels: Column | str, tags: Sequence[str] = tuple(PUBLIC_LABELS)) -> Column:
    """Sampling buckets of a row: its active tags, or the single bucket ``none``."""
    labels = as_col(labels)
    active = F.array_compact(F.array(*[F.when(F.try_element_at(labels, F.lit(t)) == 1, F.lit(t)) for t in tags]))
    return F.when(F.size(active) > 0, active).otherwise(F.array(F.lit("none")))


def upgrade_record(row: Column) -> Column:
    """Current metadata record from any earlier shape (see ``schemas.LEGACY_METADATA``), null if it has no key.

    The oldest shape has only a file name; the middle one blends three scores and nests the mood.
    """
    audio = blank_to_null(row["audio"])
    blended = 0.5 * clamp_unit(row["S"]) + 0.3 * clamp_unit(row["R"]) + 0.2 * clamp_unit(row["D"])
    has_scores = row["S"].isNotNull() & row["R"].isNotNull() & row["D"].isNotNull()
    confidence = (
        F.when(row["confidence"].isNotNull(), quantise_confidence(row["confidence"]))
        .when(has_scores, F.bround(blended, 2))
        .otherwise(F.lit(0.0))
    )
    current = F.struct(
        audio.alias("audio"),
        F.coalesce(strip(row["text"]), F.lit("")).alias("text"),
        F.coalesce(blank_to_null(row["mood"]), blank_to_null(row["tags"]["mood"])).alias("mood"),
        confidence.alias("confidence"),
    )
    name_only = F.struct(
        blank_to_null(row["filename"]).alias("audio"),
        F.lit("").alias("text"),
        F.lit(None).cast("string").alias("mood"),
        F.lit(0.0).alias("confidence"),
    )
    return F.when(audio.isNotNull(), current).when(blank_to_null(row["filename"]).isNotNull(), name_only)


def parse_response(raw: Column | str, key: Column | str) -> Column:
    """Metadata record from a model's JSON answer; an unreadable answer gives the failure record."""
    raw, key = as_col(raw), as_col(key)
    schema = "audio STRING, text STRING, mood STRING, confidence DOUBLE, _bad STRING"
    parsed = F.from_json(raw, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    readable = F.startswith(strip(raw), F.lit("{")) & F.try_parse_json(raw).isNotNull()
    keep = F.coalesce(readable, F.lit(False))
    return F.struct(
        F.coalesce(F.when(keep, blank_to_null(parsed["audio"])), key).alias("audio"),
        F.coalesce(F.when(keep, strip(parsed["text"])), F.lit("")).alias("text"),
        F.when(keep, blank_to_null(parsed["mood"])).alias("mood"),
        F.when(keep, quantise_confidence(parsed["confidence"])).otherwise(F.lit(0.0)).alias("confidence"),
    )


def mix_target(n_in_domain: Column, pool_size: Column, explicit: int | None = None, mix_ratio: float | None = 0.5) -> Column:
    """How many public rows to draw: explicit, or by mixing ratio, or as many as in-domain; capped by the pool."""
    if explicit is not None and explicit > 0:
        wanted = F.lit(explicit).cast("long")
    elif mix_ratio is not None and 0.0 < mix_ratio < 1.0:
        wanted = (n_in_domain * F.lit(mix_ratio) / F.lit(1.0 - mix_ratio)).cast("long")
    else:
        wanted = n_in_domain.cast("long")
    return F.least(wanted, pool_size.cast("long"))
