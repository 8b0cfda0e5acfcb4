"""Readers and writers of the formats that posts, labels and gazetteers come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.operators.skew import small_or_shuffled
from emberline.session import written

# fixed values: column names by priority
TEXT_COLUMNS = ["tweet", "text", "tweet_text", "full_text", "content", "message", "body", "tweet text"]
TIME_COLUMNS = ["created_at", "timestamp", "date", "datetime", "time", "tweet_time", "posted_at", "created"]


def read_upload(spark: SparkSession, path: str, most: int | None = 50_000) -> DataFrame:
    """A CSV of any columns, as strings; broken lines are skipped, an empty file is an error."""
    df = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', mode="DROPMALFORMED")
    if not df.columns or df.limit(1).count() == 0:
        raise ValueError("the file has no rows")
    return df if most is None else df.limit(most)


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None, trim: bool = False) -> DataFrame:
    """A CSV whose empty fields are empty strings; a byte order mark is no part of the first name."""
    df = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', emptyValue="", nullValue="\u0000", ignoreLeadingWhiteSpace=trim)
    return df.toDF(*[c.lstrip("﻿").strip() for c in df.columns])


def read_jsonl(spark: SparkSession, paths: list[str], schema: str | None = None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(paths)


def read_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated without quoting; lines that begin with # are comments."""
    return spark.read.csv(path, sep="\t", quote="", comment="#", schema=schema)


def read_by_event(spark: SparkSession, glob: str) -> DataFrame:
    """Many CSV files with their folder's name as ``event``."""
    df = spark.read.csv(glob, header=True, multiLine=True, escape='"')
    return df.withColumn("event", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def _best(columns: list[str], ranked: list[str]) -> str | None:
    """Of the columns, whatever their case, the one whose name ranks first; of several spellings the last."""
    rank = {name: i for i, name in enumerate(ranked)}
    known = [(rank[c.lower().strip()], -at, c) for at, c in enumerate(columns) if c.lower().strip() in rank]
    return min(known)[2] if known else None


def detect_columns(df: DataFrame) -> tuple[str, str | None]:
    """The text and time columns by name; without a text column, the string column with the longest mean text, of equals the first."""
    text, time = _best(df.columns, TEXT_COLUMNS), _best(df.columns, TIME_COLUMNS)
    if text is None:
        strings = [c for c, t in df.dtypes if t == "string" and c != time]
        if not strings:
            raise ValueError("no text column")
        lengths = F.array(*[F.struct(F.coalesce(F.avg(F.length(c)), F.lit(0.0)).alias("mean"), F.lit(-i).alias("at")) for i, c in enumerate(strings)])
        text = strings[-df.agg(F.array_max(lengths).alias("m")).first()["m"]["at"]]
    return text, time


def with_row_ids(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Rows of files numbered from 0: files in the order of their names, rows as they stand in them, whatever the sizes and splits.

    The rows are written once with the file and the byte at which their split begins; the splits, a row each, are counted and ordered, and a row's
    number is its split's start and its place in it. ``df`` has to come from files, before any join or grouping.
    """
    spot = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    rows = written(df.select("*", *spot, F.monotonically_increasing_id().alias("_m")), "numbered")
    splits = rows.groupBy("_file", "_block").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are splits
    starts = splits.select("_file", "_block", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_start"))
    return rows.join(small_or_shuffled(starts), ["_file", "_block"]).withColumn(name, (F.col("_start") + F.col("_m")).cast("long")).drop("_file", "_block", "_m", "_start")


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    df.write.csv(path, header=True, quoteAll=quote_all, escape='"', mode="overwrite")


def write_packed(records: DataFrame, summary: DataFrame, meta: DataFrame, path: str) -> None:
    """Payload, summary and description as compressed JSON lines, loaded when first used."""
    for name, df in (("payload", records), ("summary", summary), ("meta", meta)):
        df.select(F.to_json(F.struct("*")).alias("value")).write.text(f"{path}/{name}", compression="gzip")


def read_packed(spark: SparkSession, path: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{path}/{name}")


def ledger_counts(spark: SparkSession, paths: list[str], total: int) -> DataFrame:
    """Successes, failures and calls left by a ledger of model calls."""
    df = read_jsonl(spark, paths, "ts string, hash string, failed boolean, requests_remaining long")
    a = df.agg(F.count_if(~F.coalesce("failed", F.lit(False))).alias("ok"), F.count_if("failed").alias("failed"), F.max_by("requests_remaining", F.when(F.col("requests_remaining").isNotNull(), F.col("ts"))).alias("last"), F.count("*").alias("n"))
    return a.select("ok", "failed", F.least(F.coalesce("last", F.lit(total)), F.lit(total) - F.col("n")).alias("remaining"))
