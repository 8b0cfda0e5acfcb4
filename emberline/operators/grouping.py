"""Reposts, quotes and truncated copies grouped with their originals."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.functions import text as T
from emberline.operators.components import connected_components
from emberline.operators.skew import join_on_hot_key, small_or_shuffled
from emberline.session import forget, written

MIN_PREFIX = 40
#: Rows that a task of the scan holds before it gives them on.
MOST_FOUND = 5000


def cleaned(posts: DataFrame, text: str = "text") -> DataFrame:
    """The posts whose text, cleaned, is not empty."""
    return posts.withColumn(text, T.clean_text(F.col(text))).where(F.length(text) > 0)


def keyed(posts: DataFrame, post_id: str = "post_id", text: str = "text") -> DataFrame:
    """Non-empty posts with key, embedded key and flags."""
    return cleaned(posts, text).withColumn("key", T.norm_key(F.col(text))).withColumn("inner_key", T.embedded_key(F.col(text))).withColumn("is_retweet", T.is_retweet(F.col(text))).withColumn("truncated", T.is_truncated(F.col(text)))


def key_rows(posts: DataFrame, post_id: str = "post_id") -> DataFrame:
    """(d, p), written: the digest of each key, own or embedded, with its post. Texts are read once and go through no shuffle: keys are equal where
    their SHA-256 is."""
    both = posts.select(F.explode_outer(F.array_distinct(F.array("key", "inner_key"))).alias("k"), F.col(post_id).alias("p")).where("k <> ''")
    return written(both.select(F.unhex(F.sha2("k", 256)).alias("d"), "p"), "key-rows")


def dup_edges(posts: DataFrame, post_id: str = "post_id") -> DataFrame:
    """(src, dst): a post and the first owner of one of its keys. Stars, not pairs."""
    rows = key_rows(posts, post_id)
    owner = rows.groupBy("d").agg(F.min("p").alias("src"))
    return rows.withColumnRenamed("p", "dst").join(owner, "d").where("src <> dst").select("src", "dst").distinct()


def owners(posts: DataFrame, post_id: str, least: int, most: int, openings: DataFrame) -> DataFrame:
    """(k, owner): the first ``most`` characters of each key, own or embedded, that begins with one of the openings (o, hashes of ``least`` characters), with
    its first post. Keys that differ later stay apart."""
    both = posts.select(F.explode_outer(F.array_distinct(F.array("key", "inner_key"))).alias("k"), F.col(post_id).alias("p")).where(F.length("k") >= least)
    near = both.select(F.xxhash64(F.left("k", F.lit(least))).alias("o"), F.left("k", F.lit(most)).alias("s"), F.unhex(F.sha2("k", 256)).alias("d"), "p").join(small_or_shuffled(openings), "o", "left_semi")
    return near.groupBy("d", "s").agg(F.min("p").alias("owner")).select(F.col("s").alias("k"), "owner")


def prefixed(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(prefix, owner) of keys (k, owner) and prefixes (prefix): every key with every prefix that it begins with; both are distinct.

    Keys and prefixes are dealt by ranges and sorted together: the keys of a prefix follow it. One scan keeps the prefixes that are still open on a
    stack. Prefixes that are open where a later range begins are sought by the first strings of the ranges, a row each, and put in front of it.
    """
    both = keys.select(F.col("k").alias("s"), "owner").unionByName(prefixes.select(F.col("prefix").alias("s"), F.lit(None).cast("long").alias("owner")))
    ranged = written(both.repartitionByRange("s").withColumn("part", F.spark_partition_id()), "ranged")
    firsts = sorted((r["first"].encode(), r["part"]) for r in ranged.groupBy("part").agg(F.min("s").alias("first")).collect())  # as many rows as ranges

    def carried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list = []
            for prefix in b.column(0).to_pylist():
                at = bisect.bisect_right(firsts, (prefix.encode(), 1 << 31))
                while at < len(firsts) and firsts[at][0].startswith(prefix.encode()):
                    out.append((prefix, firsts[at][1]))
                    at += 1
            yield pa.RecordBatch.from_pydict({"s": pa.array([x for x, _ in out], pa.string()), "part": pa.array([x for _, x in out], pa.int32())})

    def told(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"prefix": pa.array([p for p, _ in found], pa.string()), "owner": pa.array([o for _, o in found], pa.int64())})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stack = None, []
        for b in batches:
            found: list = []
            for own, s, owner in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if own != part:
                    part, stack = own, []
                while stack and not s.startswith(stack[-1]):
                    stack.pop()
                if owner is None:
                    stack += [s] * (not stack or stack[-1] != s)
                else:
                    found += [(p, owner) for p in stack]
                if len(found) >= MOST_FOUND:
                    yield told(found)
                    found = []
            yield told(found)

    begun = prefixes.select("prefix").mapInArrow(carried, "s string, part int").withColumn("owner", F.lit(None).cast("long"))
    rows = ranged.select("part", "s", "owner").unionByName(begun)
    # a prefix stands before a key that equals it, as nulls come first
    return rows.repartition("part").sortWithinPartitions("part", "s", F.asc_nulls_first("owner")).mapInArrow(scan, "prefix string, owner long")


def trunc_edges(posts: DataFrame, post_id: str = "post_id") -> DataFrame:
    """(src, dst): first owners of the keys that begin with a truncated post's key less its last word."""
    cut = F.regexp_replace("key", " [^ ]*$", "")
    p = written(posts.where(F.col("truncated") & (F.length("key") >= MIN_PREFIX)).select(F.col(post_id).alias("dst"), cut.alias("prefix")).where("prefix <> ''"), "truncated")
    size = p.agg(F.min(F.length("prefix")).alias("least"), F.max(F.length("prefix")).alias("most")).first()
    least, most = size["least"] or 1, size["most"] or 1
    # a key can begin with a prefix only if it begins as some prefix does; no more of it is read than the longest prefix has
    openings = written(p.select(F.xxhash64(F.left("prefix", F.lit(least))).alias("o")).distinct(), "openings")
    out = prefixed(owners(posts, post_id, least, most, openings), p.select("prefix").distinct()).join(p, "prefix")
    return out.where("owner <> dst").select(F.col("owner").alias("src"), "dst").distinct()


def grouped(posts: DataFrame, post_id: str = "post_id", text: str = "text") -> DataFrame:
    """The keyed posts with group_id (the least post id of the group), group_size and is_canonical.

    Keys are worked out once; groups are aggregates that are joined back, so a post that half of all repost meets in no one task.
    """
    p = written(keyed(posts, post_id, text), "keyed")
    return p.join(_grouped_ids(p.withColumn("_l", F.length(text)), post_id)[0], post_id)


def grouped_texts(posts: DataFrame, post_id: str = "post_id", text: str = "text") -> DataFrame:
    """:func:`grouped` less the keys, written. Keys are worked out without the texts and are gone when these are written, once; nothing else stays."""
    p = written(keyed(posts, post_id, text).select(post_id, "key", "inner_key", "is_retweet", "truncated", F.length(text).alias("_l")), "keys-of-posts")
    told, *made = _grouped_ids(p, post_id)
    told = written(told.join(p.select(post_id, "is_retweet", "truncated"), post_id), "told")
    forget(p, *made)
    out = written(cleaned(posts, text).join(told, post_id), "grouped")
    forget(told)
    return out


def _grouped_ids(p: DataFrame, post_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(post, group_id, group_size, is_canonical) of written keyed posts with the length ``_l`` of their texts; beside it the tables that it reads."""
    members = connected_components(dup_edges(p, post_id).union(trunc_edges(p, post_id)))
    lean = p.select(post_id, "is_retweet", "_l").join(members.withColumnRenamed("node", post_id), post_id, "left").select(post_id, F.coalesce("component", post_id).alias("group_id"), (F.when(F.col("is_retweet"), 0).otherwise(10000) + F.col("_l")).alias("_rank"))
    lean = written(lean, "members")
    groups = written(lean.groupBy("group_id").agg(F.count("*").alias("group_size"), F.max_by(post_id, F.struct("_rank", -F.col(post_id))).alias("_best")), "groups")
    return _told(lean, groups, post_id), lean, groups


def _told(lean: DataFrame, groups: DataFrame, post_id: str) -> DataFrame:
    g = groups.withColumn("n", F.col("group_size"))
    out = join_on_hot_key(lean, g, "group_id", "n", ["group_size", "_best"], F.col(post_id))
    return out.select(post_id, "group_id", "group_size", (F.col("_best") == F.col(post_id)).alias("is_canonical"))
