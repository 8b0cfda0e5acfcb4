"""Joins and grouped passes that stay balanced when one key holds much of the data."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes, by a scan of its rows, up to which a lookup table is broadcast; beyond it the join shuffles.
BROADCAST_BYTES = 32 << 20
#: Bytes of text that a task of an extraction takes.
TASK_BYTES = 16 << 20


def row_bytes(df: DataFrame) -> Column:
    """About what a row takes in memory: eight bytes per field and the contents of strings, binaries and arrays."""
    out = F.lit(16)
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind in ("string", "binary"):
            out = out + F.coalesce(F.octet_length(c), F.lit(0))
        elif kind == "array<string>":
            out = out + F.coalesce(F.aggregate(c, F.lit(0), lambda a, x: a + 16 + F.coalesce(F.octet_length(x), F.lit(0))), F.lit(0))
        elif kind.startswith("array<struct") or kind.startswith(("map", "struct")):
            out = out + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
        elif kind.startswith("array"):
            out = out + F.coalesce(F.size(c), F.lit(0)) * 8
        out = out + 8
    return out.cast("long")


def bytes_of(df: DataFrame) -> int:
    """The bytes of a table's rows, scanned once per frame."""
    if not hasattr(df, "_row_bytes"):
        df._row_bytes = df.agg(F.sum(row_bytes(df))).first()[0] or 0
    return df._row_bytes


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only if the measured bytes are within ``limit``; else a merge join, whose skewed partitions can be split."""
    return F.broadcast(df) if bytes_of(df) <= limit else df.hint("shuffle_merge")


def as_small_as(df: DataFrame, base: DataFrame) -> DataFrame:
    """:func:`small_or_shuffled` for what is made of ``base`` row by row and takes no more room."""
    return F.broadcast(df) if bytes_of(base) <= BROADCAST_BYTES else df.hint("shuffle_merge")


def dealt(df: DataFrame, key: str, text: str, size: int = TASK_BYTES) -> DataFrame:
    """(key, text) dealt by ``key`` to as many tasks as the texts fill, so that a task's work and memory do not grow with the table."""
    if not hasattr(df, "_text_bytes"):
        df._text_bytes = df.agg(F.sum(F.octet_length(text))).first()[0] or 0
    return df.select(key, text).repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-df._text_bytes // size)), key)


def join_on_hot_key(rows: DataFrame, groups: DataFrame, key: str, size: str, values: list[str], salt: Column, share: int = 1000) -> DataFrame:
    """Left join of ``rows`` to one row per ``key`` in ``groups`` (a written table with the group's row count in ``size``).

    Keys with more than 1/``share`` of all rows number less than ``share`` (a proven bound), so they are broadcast; their rows get a
    salted key for the shuffled join with all others, where they spread evenly and match nothing. Null keys match nothing.
    """
    total = groups.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = groups.where(F.col(size) > total / share).select(F.col(key).alias("_hk"), *[F.col(v).alias(f"_h_{v}") for v in values])
    marked = rows.join(F.broadcast(hot), F.col(key) == F.col("_hk"), "left")
    kind = dict(rows.dtypes)[key]
    spread = F.when(F.col("_hk").isNotNull(), F.concat(F.lit("~"), salt.cast("string"))).otherwise(F.col(key).cast("string")) if kind == "string" else F.struct(F.when(F.col("_hk").isNull(), F.col(key)).alias("k"), F.when(F.col("_hk").isNotNull(), salt.cast("long")).otherwise(F.lit(0).cast("long")).alias("s"))
    cold_key = F.col(key) if kind == "string" else F.struct(F.col(key).alias("k"), F.lit(0).cast("long").alias("s"))
    cold = groups.where(F.col(size) <= total / share).select(cold_key.alias("_ck"), *[F.col(v).alias(f"_c_{v}") for v in values])
    out = marked.withColumn("_sk", spread).join(cold, F.col("_sk") == F.col("_ck"), "left")
    for v in values:
        out = out.withColumn(v, F.coalesce(f"_h_{v}", f"_c_{v}"))
    return out.drop("_hk", "_sk", "_ck", *[f"_h_{v}" for v in values], *[f"_c_{v}" for v in values])


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete runs of ``key`` (an integer column, rows already sorted by it) with the offsets at which runs begin."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(k != k[-1], False)) if k[0] == k[-1] else int(np.flatnonzero(k[1:] != k[:-1])[-1]) + 1
        if held and last is not None and k[0] != last:
            yield _table(held, key)
            held = []
        if k[0] != k[-1]:
            held.append(b.slice(0, cut))
            yield _table(held, key)
            held = [b.slice(cut)]
        else:
            held.append(b)
        last = k[-1]
    if held:
        yield _table(held, key)


def _table(held: list[pa.RecordBatch], key: str) -> tuple[pa.Table, np.ndarray]:
    t = pa.Table.from_batches(held).combine_chunks()
    k = t.column(key).to_numpy()
    return t, np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))


def grouped_pass(df: DataFrame, key: str, order: list[str], fn: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], schema: str, partitions: int | None = None) -> DataFrame:
    """Shuffle by the integer ``key``, sort, and hand ``fn`` tables of whole groups: one call serves many small groups.

    ``partitions`` is for data whose size the caller has counted; else the session's number holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in whole_groups(batches, key):
            yield from fn(t, starts)

    dealt = df.repartition(key) if partitions is None else df.repartition(partitions, key)
    return dealt.sortWithinPartitions(key, *order).mapInArrow(run, schema)
