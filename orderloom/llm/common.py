"""What several operators need: written intermediate tables, texts as bytes, string hashes."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderloom.sources.store import scratch_folder

WORD = r"[^\x20\x09-\x0D]+"
# A text is known by these two hashes of its content, 96 bits in all.
KEY = ("k1", "k2")
# What a broadcast may hold: so many cells of some 40 bytes, 40 MB.
BROADCAST_CELLS = 1_000_000
_SPACES = (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: computed once, and independent of any executor."""
    path = scratch_folder(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """The UTF-8 bytes of each text; a null is empty."""
    for value in column.cast(pa.binary()).to_pylist():
        yield value or b""


def stretches(text: bytes, size: int = 4 << 20) -> Iterator[bytes]:
    """A text in parts of about one size, each cut behind an ASCII space; a longer word stays whole."""
    at = 0
    while at < len(text):
        end = at + size
        if end < len(text):
            end = max(text.rfind(s, at, end) for s in _SPACES) + 1
            if end <= at:
                end = min((f for s in _SPACES if (f := text.find(s, at + size)) >= 0), default=len(text) - 1) + 1
        yield text[at:end]
        at = end


def give_back() -> None:
    """Hand what this worker no longer uses back to the system: it lives on through the stages that follow."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def crc_mod(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string")) % modulus


def unit_hash(*columns: Column) -> Column:
    """A number in [0, 2^62) from the columns; the same on every run."""
    return F.xxhash64(*columns).bitwiseAND(F.lit((1 << 62) - 1))


def lengths_to_offsets(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([np.zeros(1, np.int64), np.cumsum(lengths, dtype=np.int64)])


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with so many underscores behind it that the table has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def text_key(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias(KEY[0]), F.hash(text).alias(KEY[1])]


def joined_to_texts(texts: DataFrame, small: DataFrame, how: str = "inner", cells: Column | None = None) -> DataFrame:
    """Rows with KEY and a text, joined to a written table by KEY.

    The texts stay where they are if the table's cells (1 a row, if not said otherwise) are counted and few
    enough for a broadcast; beyond that both sides are shuffled.
    """
    n = small.agg(F.sum(F.lit(1) if cells is None else cells)).first()[0] or 0
    return texts.join(F.broadcast(small) if n <= BROADCAST_CELLS else small, list(KEY), how)
