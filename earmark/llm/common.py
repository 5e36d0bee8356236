"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earmark.session import pin, shared_dir  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only; all other characters stay."""
    return F.translate(text, UPPER, LOWER)


def words(raw: bytes) -> list[bytes]:
    """Maximal runs without the bytes 0x20 and 0x09-0x0D, A-Z lower-cased."""
    return raw.translate(_ASCII_LOWER).split()


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus))


def keyed_texts(df: DataFrame, *columns: str) -> DataFrame:
    """:func:`keyed` for rows that go to Python. Texts can be long, so the session's Arrow batches are held to ``BATCH`` rows."""
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(df.sparkSession.conf.get(setting)) <= BATCH:
        df.sparkSession.conf.set(setting, str(BATCH))
    return keyed(df, *columns)


def keyed(df: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, as _c0, _c1, ...: other columns of any name can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])


#: Rows of a batch that are Python objects at once.
ROWS = 256
BATCH = 1024


def pieces(batch: pa.RecordBatch, rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """A batch in slices, so that Python objects exist for few rows at a time."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)



def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores before it until no column has it (letter case apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name
