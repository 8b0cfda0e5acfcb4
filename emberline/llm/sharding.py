"""Sharding by jump consistent hashing.

Law ``key``: the key and the number of shards decide the shard; with one shard more, a row stays or goes to the new shard. No ring
table exists. Defined cases: integer keys are hashed as they are, keys of any other type by a hash of their value; a null key counts as
the key -1; a null text as the empty text; texts are measured whole, however long; equal keys share a shard; an empty table gives no rows;
columns named like the result's are replaced, and others are ignored by ``assign`` and kept by ``sharded``. Repeated rows, of one key and one
text, are interchangeable: they are counted before they are numbered, so a third of all rows may be one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.session import table, written

SHARDS = 8
#: Rows that one task numbers, on average.
SLOT_ROWS = 20_000
#: Slots of repeated rows that stand in one array.
PIECE = 4096


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Bucket of each 64-bit key among ``shards`` buckets; all keys advance together until each has passed the last bucket."""
    state = keys.astype(np.uint64)
    bucket = np.zeros(len(state), np.int64)
    jump = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(live):
            bucket[live] = jump[live]
            state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = ((state[live] >> np.uint64(33)) + np.uint64(1)).astype(np.float64)
            jump[live] = ((bucket[live] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            live = live[jump[live] < shards]
    return bucket


def mixed(keys: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers, so that consecutive keys are unrelated."""
    x = keys.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shard_of(key, shards: int, kind: str = "bigint"):
    """Column expression: the shard of a key whose type is ``kind``."""

    @F.pandas_udf("int")
    def of(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for k in parts:
            yield pd.Series(jump_hash(mixed(k.to_numpy(np.int64)), shards).astype(np.int32))

    return of(number_of(F.col(key) if isinstance(key, str) else key, kind))


def number_of(key: Column, kind: str) -> Column:
    """A key as a 64-bit number: integers as they are, others by a hash; null is -1."""
    return F.when(key.isNull(), F.lit(-1).cast("long")).otherwise(key.cast("long") if kind in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key))


def assign(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id", text: str = "text", slot_rows: int = SLOT_ROWS) -> DataFrame:
    """``key``, size, text_crc32, law, shard, slot, grown_shard: the assignment without the texts.

    Slots are numbered within a shard in the order of a hash of the row. Repeated rows are counted first; the distinct ones of a shard are
    dealt into cells of about ``slot_rows`` rows by the high part of that hash; each cell is numbered alone, by running sums of the counts, and
    starts where the cells before it end.
    """
    body, kind = F.coalesce(F.col(text), F.lit("")), dict(docs.dtypes)[key]
    lean = docs.select(F.col(key).alias("k"), (F.octet_length(body).cast("long") + 1).alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"))
    rows = written(lean.groupBy("k", "size", "text_crc32").agg(F.count("*").alias("n")), "rows")
    cells = max(1, -(-rows.count() // (shards * slot_rows)))
    placed = (
        rows.withColumn("shard", shard_of("k", shards, kind))
        .withColumn("grown_shard", shard_of("k", shards + 1, kind))
        .withColumn("_o", F.xxhash64("k", "text_crc32", "size"))
        .withColumn("_cell", F.floor((F.shiftrightunsigned("_o", 33)).cast("double") * cells / float(1 << 31)).cast("int"))
    )
    counts = placed.groupBy("shard", "_cell").agg(F.sum("n").alias("_n"))
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_cell", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_cell").orderBy("_o", "k", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumn("_r", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, ["shard", "_cell"])
    # the slots of repeated rows, in pieces: no array holds them all
    pieces = numbered.withColumn("_p", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {PIECE}"))))
    each = pieces.withColumn("_i", F.explode(F.sequence(F.col("_p") * PIECE, F.least(F.col("_p") * PIECE + PIECE, F.col("n")) - 1)))
    return each.select(F.col("k").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_r") + F.col("_i")).cast("long").alias("slot"), "grown_shard")


def sharded(docs: DataFrame, shards: int = SHARDS, key: str = "doc_id") -> DataFrame:
    """The rows with their shard."""
    return docs.drop("shard").withColumn("shard", shard_of(key, shards, dict(docs.dtypes)[key]))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, key: str = "doc_id") -> None:
    """One folder per shard, in as many files as the data need: rows are rebalanced, not gathered by shard."""
    sharded(docs, shards, key).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
