"""Text refinement with pluggable batch functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.functions.encoders import Encoder, encode_columns
from earmark.functions.keys import blank_to_null, resolve_path
from earmark.functions.vectors import cosine
from earmark.operators.filters import gate
from earmark.operators.merging import add_hard_duplicates, remaining
from earmark.operators.ordering import keep_one
from earmark.operators.sampling import hard_ranks, mine_hard
from earmark.session import pin

Refine = Callable[[pd.Series], pd.Series]


def refine_rows(rows: DataFrame, prompt: str, load: Callable[[], Refine], out: str = "text_new", batch_rows: int = 256) -> DataFrame:
    """Add ``out`` = the refiner's answer to ``prompt``; null where it drops the row. ``load`` runs once per task.

    ``prompt`` is a column, so filters on the rows belong before this call. Rows pass as Arrow batches; only the prompts of
    ``batch_rows`` of them are Python objects at a time.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    position = rows.columns.index(prompt)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        refine = load()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_rows):
                batch = whole.slice(start, batch_rows)
                answers = refine(batch.column(position).to_pandas())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(answers, pa.string(), from_pandas=True)], names=[*batch.schema.names, out])

    return rows.mapInArrow(run, schema)


def no_op() -> Callable[[], Refine]:
    """Refiner that answers with its input."""
    return lambda: lambda texts: texts


def gate_refined(
    rows: DataFrame, item_vec: str, load_encoder: Callable[[], Encoder], min_sim_gain: float = 0.0, min_text_cos: float = 0.85,
    strict: bool = True, old: str = "text_orig", new: str = "text_new", old_vec: str | None = None,
) -> DataFrame:
    """Add the gate diagnostics of a refined text. Each distinct text is encoded once; ``old_vec`` names a column that has the old text's vector already."""
    rows = pin(rows, "refined").withColumn("_answered", F.col(new).isNotNull())
    if old_vec is None:
        encoded = encode_columns(rows, {old: "_old_vec", new: "_new_vec"}, load_encoder)
    else:
        encoded = encode_columns(rows, {new: "_new_vec"}, load_encoder).withColumn("_old_vec", F.col(old_vec))
    sims = encoded.withColumns({
        "_sim_old": cosine(item_vec, "_old_vec"), "_sim_new": cosine(item_vec, "_new_vec"), "_text_cos": cosine("_old_vec", "_new_vec")})
    tested = gate("_sim_old", "_sim_new", "_text_cos", min_sim_gain, min_text_cos, strict).withField("answered", F.col("_answered"))
    return sims.withColumn("gate", tested).drop("_old_vec", "_new_vec", "_sim_old", "_sim_new", "_text_cos", "_answered")


def accepted_rows(gated: DataFrame, iteration: int, text_source: str = "llm_refined", new: str = "text_new") -> DataFrame:
    return gated.filter(F.col(new).isNotNull() & F.col("gate.accepted")).withColumns(
        {"text": F.col(new), "text_source": F.lit(text_source), "iter": F.lit(iteration)}).drop(new)


def gate_counts(gated: DataFrame, new: str = "text_new") -> DataFrame:
    """One row: rows in, accepted, rejected for similarity or for drift, dropped by the refiner. The gate tells it, so that no text is read for it."""
    answered = F.col("gate.answered") if "answered" in gated.schema["gate"].dataType.names else F.col(new).isNotNull()
    return gated.agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(answered & F.col("gate.accepted")).alias("n_accepted"),
        F.count_if(answered & (F.col("gate.reject_reason") == "sim")).alias("n_rejected_sim"),
        F.count_if(answered & (F.col("gate.reject_reason") == "drift")).alias("n_rejected_drift"),
        F.count_if(~answered).alias("n_dropped"))


def unique_songs(clips: DataFrame, root: str = "/", order: str = "_ord", min_confidence: float | None = None) -> DataFrame:
    """First clip per song, keyed by the resolved source path (``song_key``)."""
    rows = clips.filter(blank_to_null("source_path").isNotNull()).withColumn("song_key", resolve_path("source_path", root))
    if min_confidence is not None:
        rows = rows.filter(F.coalesce(F.col("confidence").try_cast("double"), F.lit(0.0)) >= min_confidence)
    return keep_one(rows, ["song_key"], [order])


def refine_songs(
    clips: DataFrame, ledger: DataFrame, prompt, load: Callable[[], Refine], root: str = "/", order: str = "_ord", texts: DataFrame | None = None,
) -> DataFrame:
    """New ledger rows: one refiner call per song that the ledger lacks. Songs the refiner drops are retried later.

    ``texts`` (source_path, text), one row a song, is given where the clips have no text of their own: a long text is joined to its song
    then, not carried by each of its clips.
    """
    songs = unique_songs(clips, root, order)
    done = ledger.select(resolve_path("source_path", root).alias("song_key"), F.lit("ok").alias("status"))
    todo = remaining(songs, done, "song_key")
    if texts is not None:
        todo = todo.join(texts.select(resolve_path("source_path", root).alias("song_key"), "text"), "song_key", "left")
    answered = refine_rows(todo.select("source_path", "text", prompt.alias("_prompt")), "_prompt", load)
    return answered.filter(blank_to_null("text_new").isNotNull()).select(
        "source_path", F.col("text_new").alias("text"), F.col("text").alias("text_orig"), F.lit("llm_full_corpus").alias("text_source"))


def self_train_round(
    train: DataFrame, item_vec: str, load_encoder: Callable[[], Encoder], load_refiner: Callable[[], Refine], iteration: int,
    fraction: float = 0.2, min_sim_gain: float = 0.0, min_text_cos: float = 0.85, hard_weight: float = 2.0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One round on (audio_path, text, vector): mined hard rows, gated rows, and the mixed manifest."""
    scored = encode_columns(train, {"text": "_text_vec"}, load_encoder).withColumn("sim", cosine(item_vec, "_text_vec"))
    # The hard rows keep their vectors where they lie; their ranks are joined when the vectors are gone.
    hard = mine_hard(scored, "sim", "audio_path", fraction, ranks=False).withColumn("text_orig", F.col("text"))
    # Written, so that the refiner answers once, whichever results are used. The old text's vector is known from the mining.
    refined_rows = refine_rows(hard, "text_orig", load_refiner)
    gated = pin(gate_refined(refined_rows, item_vec, load_encoder, min_sim_gain, min_text_cos, old_vec="_text_vec").drop("_text_vec"), "gated")
    refined = accepted_rows(gated, iteration).withColumn("_ord", F.lit(0))
    mixed = add_hard_duplicates(train, hard, refined, iteration, hard_weight)
    return hard_ranks(hard.drop(item_vec, "_text_vec"), "sim", "audio_path"), gated.drop("_n"), mixed
