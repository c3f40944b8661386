"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..session import ensure_checkpoint_dir
from ..sources.tables import read_table

WORD_CHARS = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
SPACE_CHARS = b"\x20\x09\x0a\x0b\x0c\x0d"
#: Arrow batches handed to Python hold at most this many rows; texts average a
#: few KB, and Spark's own byte limit per batch bounds longer ones.
BATCH_ROWS = 2000


def prepare(spark: SparkSession) -> None:
    """The session settings the operators rely on."""
    ensure_checkpoint_dir(spark)
    for key, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.adaptive.enabled", "true"),
                       ("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))):
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in a prepared session."""
    prepare(spark)
    return read_table(spark, sf_dir, name)


def fresh_names(df: DataFrame, *stems: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in stems:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def byte_table(keep: bytes) -> bytes:
    """A translation table: A-Z to a-z, bytes of ``keep`` as they are, all
    others to a blank, so that ``translate().split()`` yields the words."""
    lower = bytes(range(256)).lower()
    return bytes(c if c in keep else 0x20 for c in lower)


#: words of the 13-word rule: runs of 0-9, a-z and everything outside ASCII
PLAIN_WORDS = byte_table(WORD_CHARS)
#: words of the shingle rule: runs of anything but blanks and line ends
SPACED_WORDS = byte_table(bytes(c for c in range(256) if c not in SPACE_CHARS))


def words(text: str | None, rule: bytes) -> list[bytes]:
    """Lower-cased (A-Z only) words of a text as UTF-8 bytes; null has none.
    Bytes outside ASCII are never separators, so UTF-8 needs no decoding."""
    return [] if text is None else text.encode().translate(rule).split()


def batches(it: Iterator[pa.RecordBatch], max_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that each holds about ``max_bytes`` (one row at least)."""
    for b in it:
        step = max(1, int(b.num_rows * max_bytes / max(b.nbytes, 1)))
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (splitmix64)."""
    x = x.copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def link_rows(rows: list[tuple[int, int | None, int]]) -> pd.DataFrame:
    """Rows (a, b, n) with 64-bit ids, b null in counts; a float column would
    not hold them."""
    a, b, n = zip(*rows) if rows else ((), (), ())
    return pd.DataFrame({"a": np.array(a, np.int64), "b": pd.array(list(b), dtype="Int64"), "n": np.array(n, np.int64)})
