"""Batch encoders. A real encoder plugs in as a function from a list of texts to a matrix."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earmark.operators.search import vector_matrix
from earmark.session import pin

Encoder = Callable[[list[str]], np.ndarray]


def hash_encoder(dim: int = 8) -> Callable[[], Encoder]:
    """Deterministic test encoder: bytes of the text's digest, centred on zero. At most 16 dimensions."""

    def load() -> Encoder:
        def encode(texts: list[str]) -> np.ndarray:
            digests = [hashlib.md5(t.encode("utf-8")).digest()[:dim] for t in texts]
            return np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(len(texts), dim) / 255.0 - 0.5

        return encode

    return load


def encode_column(df: DataFrame, text: str, vector: str, load: Callable[[], Encoder], batch_size: int = 256) -> DataFrame:
    """Add ``vector`` by encoding ``text`` in batches. ``load`` runs once per task, so a model is loaded once."""
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])
    position = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = load()
        for whole in batches:
            for start in range(0, whole.num_rows, batch_size):
                batch = whole.slice(start, batch_size)
                matrix = encode([t or "" for t in batch.column(position).to_pylist()])
                vectors = pa.array(list(np.asarray(matrix, dtype=np.float32)), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, vector])

    return df.mapInArrow(run, schema)


def encode_columns(df: DataFrame, columns: Mapping[str, str], load: Callable[[], Encoder], batch_size: int = 256) -> DataFrame:
    """Add a vector for each text column (``{text: vector}``). Each distinct text of all columns is encoded once, in one pass over one table.

    The vectors are stored with the texts' SHA-256, and rows are joined to them by it: texts move once, to be told apart, and no more
    unless the result's own texts are used. A null text has the vector of the empty text.
    """
    def digest(text: str) -> Column:
        return F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256))

    texts = [df.select(F.coalesce(F.col(c), F.lit("")).alias("_text")) for c in columns]
    encoded = encode_column(reduce(DataFrame.union, texts).distinct(), "_text", "_vec", load, batch_size)
    known = pin(encoded.select(digest("_text").alias("_digest"), "_vec"), "texts")
    df = df.withColumns({f"_digest_{vector}": digest(text) for text, vector in columns.items()})
    for vector in columns.values():
        df = df.join(known.select(F.col("_digest").alias(f"_digest_{vector}"), F.col("_vec").alias(vector)), f"_digest_{vector}", "left").drop(f"_digest_{vector}")
    return df


def project_features(df: DataFrame, features: str, vector: str, weights: np.ndarray) -> DataFrame:
    """Add ``vector`` = unit-length projection of cached features by a weight matrix."""
    schema = T.StructType([*df.schema.fields, T.StructField(vector, T.ArrayType(T.FloatType()))])
    position = df.columns.index(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            projected = vector_matrix(batch.column(position)) @ weights
            length = np.linalg.norm(projected, axis=1, keepdims=True)
            projected = projected / np.maximum(length, 1e-12)
            vectors = pa.array(list(projected.astype(np.float32)), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], names=[*batch.schema.names, vector])

    return df.mapInArrow(run, schema)
