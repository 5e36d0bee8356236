"""Language identification by words first, backing off to character n-grams.

A word that the model knows scores its log frequency in each language. An unknown word is scored by the mean log frequency
of its longest n-grams that the model knows: four characters, then three, two, one. A text scores the mean over its words.

Defined results: a null text, or one without a letter, gives ``und`` with score 0. Equal scores go to the language that
sorts first. A text whose letters the model has never seen gives all languages the same score, 1 / number of languages.
Repeated rows are predicted alike and teach once; very long texts are read whole; extra columns are kept, and one that has the name of the
result is an error. An empty training table gives ``und`` for every text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earmark.llm.common import ROWS, keyed_texts, pin

UNDETERMINED = "und"
MAX_N = 4
#: Distinct training texts drawn for each language, by a hash of the text (a text is in or out whatever its neighbours).
TEXTS_PER_LANGUAGE = 3000
#: Most frequent words, and n-grams of each length, that are kept for a language.
WORDS_PER_LANGUAGE = 30_000
GRAMS_PER_LANGUAGE = 15_000
#: log10 frequency of what a language has never had.
FLOOR = -7.0
_LETTERS = re.compile(r"[^\W\d_]+")
#: Pieces of text between spaces whose evidence a task remembers, and their characters.
_MEMO, _MEMO_CHARS = 100_000, 4_000_000
_CHUNK = 1 << 14


class _Evidence:
    """For each piece of text between spaces, the log frequencies of its words summed by language, then the number of words.

    What is remembered is bounded by ``_MEMO`` and ``_MEMO_CHARS`` besides the pieces of the text at hand.
    """

    def __init__(self, model: LanguageModel):
        self.model = model
        self.floor = len(model.table)
        self.table = np.vstack([model.table, np.full(len(model.languages), FLOOR)])
        self.forget()

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.model.languages) + 1))
        self.chars = 0

    def add(self, pieces: list[str]) -> None:
        at: list[int] = []
        weights: list[float] = []
        ends, numbers = [], []
        for piece in pieces:
            number = 0
            for word in _LETTERS.findall(piece):
                rows = self.model.word_rows(word)
                if rows is None:
                    continue
                number += 1
                rows = rows or [self.floor]
                at += rows
                weights += [1.0 / len(rows)] * len(rows)
            ends.append(len(at))
            numbers.append(number)
        used = len(self.place)
        while used + len(pieces) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        made = self.rows[used : used + len(pieces)]
        made[:] = 0.0
        made[:, -1] = numbers
        some = np.flatnonzero(made[:, -1])
        if len(some):
            starts = np.concatenate([[0], ends[:-1]])[some].astype(np.int64)
            made[some, :-1] = np.add.reduceat(self.table[at] * np.array(weights)[:, None], starts, axis=0)
        self.place.update(zip(pieces, range(used, used + len(pieces))))
        self.chars += sum(map(len, pieces))

    def total(self, parts: list[str]) -> np.ndarray:
        if len(self.place) > _MEMO or self.chars > _MEMO_CHARS:
            self.forget()
        new = [piece for piece in dict.fromkeys(parts) if piece not in self.place]
        for start in range(0, len(new), _CHUNK):
            self.add(new[start : start + _CHUNK])
        total = np.zeros(self.rows.shape[1])
        for start in range(0, len(parts), _CHUNK):
            part = parts[start : start + _CHUNK]
            total += self.rows[np.fromiter(map(self.place.__getitem__, part), np.int64, len(part))].sum(axis=0)
        return total


class LanguageModel:
    """Log frequencies by language; pickled to the executors, its size bounded by the parameters of :func:`fit`."""

    def __init__(self, languages: list[str], words: dict[str, int], grams: list[dict[str, int]], table: np.ndarray):
        self.languages, self.words, self.grams, self.table = languages, words, grams, table
        self.evidence: _Evidence | None = None

    def __getstate__(self):
        return {**self.__dict__, "evidence": None}

    def word_rows(self, word: str) -> list[int] | None:
        """Rows of the table that a word's score is the mean of: its own, or those of its longest known n-grams. None without a letter."""
        row = self.words.get(word)
        if row is not None:
            return [row]
        if not word.isalpha():
            word = "".join(c for c in word if c.isalpha())
            if not word:
                return None
        padded = f" {word} "
        for n in range(MAX_N, 0, -1):
            known, whole = self.grams[n - 1], padded if n > 1 else word
            at = [known[g] for g in [whole[i : i + n] for i in range(len(whole) - n + 1)] if g in known]
            if at:
                return at
        return []

    def scores(self, text: str) -> np.ndarray | None:
        """Mean log10 frequency by language; None without a letter. No word reaches over a space, so pieces between spaces are added up."""
        if self.evidence is None:
            self.evidence = _Evidence(self)
        total = self.evidence.total(text.lower().split())
        return total[:-1] / total[-1] if total[-1] else None

    def predict(self, text: str | None) -> tuple[str, float]:
        mean = self.scores(text) if text and self.languages else None
        if mean is None:
            return UNDETERMINED, 0.0
        share = 10.0 ** (mean - mean.max())
        return self.languages[int(mean.argmax())], float(share.max() / share.sum())


def fit(docs: DataFrame, text: str, lang: str, texts_per_language: int = TEXTS_PER_LANGUAGE) -> LanguageModel:
    """Learn from a bounded sample of labelled rows; rows without text or language are left out.

    Words and n-grams are counted by Spark. What reaches the driver is bounded by the kept words and n-grams of a language.
    """
    rows = keyed_texts(docs, text, lang).filter(F.col("_c0").isNotNull() & F.col("_c1").isNotNull())
    # Written first, so that Spark knows how small the table is and needn't shuffle the texts for the join.
    # Copies count once, here and in the draw, so that the bound holds and no text outweighs the others by its copies.
    sizes = pin(rows.groupBy("_c1").agg(F.count_distinct(F.xxhash64("_c0")).alias("n")), "languages")
    draw = F.pmod(F.xxhash64("_c0"), F.lit(1_000_000)) * F.col("n") < F.lit(1_000_000 * texts_per_language)
    drawn = rows.join(sizes, "_c1").filter(draw).select("_c0", "_c1").distinct()
    found = drawn.select(F.col("_c1").alias("lang"), F.explode(F.regexp_extract_all(F.lower("_c0"), F.lit(r"(\p{L}+)"), 1)).alias("part"))
    counted = pin(found.groupBy("lang", "part").agg(F.count(F.lit(1)).alias("n")), "words")

    def split(n: int) -> Column:
        """All n-grams of a word, with the spaces around it but for single characters."""
        whole = F.concat(F.lit(" "), "part", F.lit(" ")) if n > 1 else F.col("part")
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(whole) - (n - 1), F.lit(1))), lambda i: F.substring(whole, i, F.lit(n)))

    grams = [counted.select("lang", F.lit(n).alias("size"), "n", F.explode(split(n)).alias("part")) for n in range(1, MAX_N + 1)]
    parts = counted.select("lang", F.lit(0).alias("size"), "n", "part")
    for g in grams:
        parts = parts.unionByName(g)
    parts = parts.groupBy("lang", "size", "part").agg(F.sum("n").alias("n"))
    kind = Window.partitionBy("lang", "size")
    kept = (
        parts.withColumn("all", F.sum("n").over(kind))
        .withColumn("place", F.row_number().over(kind.orderBy(F.desc("n"), "part")))
        .filter(F.col("place") <= F.when(F.col("size") == 0, WORDS_PER_LANGUAGE).otherwise(GRAMS_PER_LANGUAGE))
        .select("lang", "size", "part", F.log10(F.col("n") / F.col("all")).alias("score")).toArrow().to_pandas())
    languages = sorted(kept["lang"].unique())
    at_language = {x: i for i, x in enumerate(languages)}
    known: list[dict[str, int]] = [{} for _ in range(MAX_N + 1)]
    places: dict[tuple[int, str], int] = {}
    for size, part in zip(kept["size"], kept["part"]):
        known[size][part] = places.setdefault((size, part), len(places))
    table = np.full((len(places), len(languages)), FLOOR, np.float32)
    for name, size, part, score in zip(kept["lang"], kept["size"], kept["part"], kept["score"]):
        table[places[size, part], at_language[name]] = max(score, FLOOR)
    return LanguageModel(languages, known[0], known[1:], table)


def prediction(model: LanguageModel, text: Column, spark) -> Column:
    """Struct (lang, score) for each text."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def predict(texts: pa.Array) -> pa.Array:
        told = [shared.value.predict(x) for start in range(0, len(texts), ROWS) for x in texts.slice(start, ROWS).to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64())], names=["lang", "score"])

    return predict(text)


def identify(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "_language") -> DataFrame:
    """``docs`` with a struct column ``out`` (lang, score), a name that ``docs`` lacks."""
    if out.lower() in map(str.lower, docs.columns):
        raise ValueError(f"there is a column {out} already")
    return docs.withColumn(out, prediction(model, F.col(f"`{text}`"), docs.sparkSession))
