"""Caption, tag and prompt text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from earmark.constants import PRIMARY_TAGS
from earmark.functions.keys import as_col, blank_to_null, strip

# Instruction lines of the three prompts and the line that closes each.
PROMPT_IMPROVE = "Improve this music caption so it better matches the audio for retrieval."
PROMPT_REWRITE = (
    "Rewrite this music caption for retrieval. Keep the same facts. Explicitly mention instrumentation and mood"
    " when present (e.g. piano, vocal, relaxing)."
)
PROMPT_EXPAND = (
    "Expand this tag-based music description into a short natural-language caption for retrieval. Keep the same"
    " tags and facts; do not add new instruments or moods."
)
PROMPT_CLOSE = "Return only the revised caption."


def strip_music_suffix(text: Column | str) -> Column:
    """Drop one trailing ' music', any case."""
    return strip(F.regexp_replace(strip(text), r"(?i) music$", ""))


def letters_only(text: Column | str) -> Column:
    """Keep letters of any script and white space."""
    return F.regexp_replace(as_col(text), r"[^\p{L}\p{Z}\s\x0b\x1c-\x1f\x85]", "")


def compose_caption(text: Column | str, mood: Column | str) -> Column:
    """Text to embed: caption with mood, either alone, or a fixed phrase when both are blank."""
    text, mood = blank_to_null(text), blank_to_null(mood)
    return F.coalesce(
        F.concat(text, F.lit(". mood: "), mood), text, F.concat(F.lit("music mood "), mood), F.lit("unknown music")
    )


def tag_caption(labels: Column | str, tags: Sequence[tuple[str, str]] = PRIMARY_TAGS, fallback: str = "music") -> Column:
    """Struct (text, text_source) from a label map: active tag words, or the fallback word."""
    labels = as_col(labels)
    words = F.array_compact(F.array(*[F.when(F.try_element_at(labels, F.lit(t)) == 1, F.lit(w)) for t, w in tags]))
    has_tag = F.size(words) > 0
    return F.struct(
        F.when(has_tag, F.array_join(words, ", ")).otherwise(F.lit(fallback)).alias("text"),
        F.when(labels.isNull(), F.lit("tag_no_gold"))
        .when(has_tag, F.lit("tag_primary"))
        .otherwise(F.lit("tag_fallback"))
        .alias("text_source"),
    )


def labelled_line(label: str, value: Column) -> Column:
    """``label: value``, or null (and so no line at all) where the value is null."""
    return F.concat(F.lit(f"{label}: "), value)


def improve_prompt(text: Column, mood: Column, confidence: Column, source: Column, sim: Column) -> Column:
    """Prompt for a hard pair, with its similarity to four decimals."""
    return F.concat_ws(
        "\n",
        F.lit(PROMPT_IMPROVE),
        labelled_line("Original caption", F.coalesce(text, F.lit(""))),
        labelled_line("Mood hint", F.when(blank_to_null(mood).isNotNull(), mood)),
        labelled_line("Metadata confidence", confidence.cast("string")),
        labelled_line("Source track", F.nullif(source, F.lit(""))),
        labelled_line("Current CLAP audio-text similarity", F.when(sim.isNotNull(), F.format_string("%.4f", sim))),
        F.lit(PROMPT_CLOSE),
    )


def rewrite_prompt(text: Column, mood: Column, confidence: Column) -> Column:
    """Prompt for one caption of the whole corpus."""
    return F.concat_ws(
        "\n",
        F.lit(PROMPT_REWRITE),
        labelled_line("Original caption", F.coalesce(strip(text), F.lit(""))),
        labelled_line("Mood hint", blank_to_null(mood)),
        labelled_line("Metadata confidence", confidence.cast("string")),
        F.lit(PROMPT_CLOSE),
    )


def expand_prompt(tag_text: Column, text_source: Column) -> Column:
    """Prompt that turns a tag list into a sentence."""
    return F.concat_ws(
        "\n",
        F.lit(PROMPT_EXPAND),
        labelled_line("Tag description", F.coalesce(strip(tag_text), F.lit(""))),
        labelled_line("Source", blank_to_null(text_source)),
        F.lit(PROMPT_CLOSE),
    )
