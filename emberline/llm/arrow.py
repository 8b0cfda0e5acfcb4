"""Passes over Arrow batches whose memory is bounded and given back."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of rows that pass between the JVM and Python at a time; a longer row passes alone.
BATCH_BYTES = 8 << 20
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def give_back() -> None:
    """Return what this process no longer uses: workers stay alive for later tasks, beside the JVM's own work."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def arrow_pass(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow``, in batches of ``BATCH_BYTES`` (the session's limit is lowered to that) and giving memory back after each task."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_LIMIT).rstrip("bB")) <= BATCH_BYTES:
        conf.set(_LIMIT, BATCH_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from fn(batches)
        finally:
            give_back()

    return df.mapInArrow(run, schema)
