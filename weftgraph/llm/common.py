"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.storage import discard, materialize, scratch_path, shared_dir

__all__ = ["chunks", "discard", "id_crc", "lean", "materialize", "read", "scratch_path", "shared_dir"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def id_crc(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def chunks(texts: list[str | None], most: int = 1_000_000) -> Iterator[tuple[int, list[str]]]:
    """(position of the first text, texts) of about `most` characters; null becomes empty; a longer text stands alone."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if i > begin and size + n > most:
            yield begin, [t or "" for t in texts[begin:i]]
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, [t or "" for t in texts[begin:]]


def give_back() -> None:
    """Returns freed memory to the system: idle Python workers of an executor share its limit with the busy ones."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The map function run, giving memory back at the end of each task."""

    def wrapped(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped
