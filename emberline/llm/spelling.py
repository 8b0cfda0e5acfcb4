"""Spelling variants by a rare-first prefix filter over positional bigrams.

Words are counted per task before anything is shuffled. The bigrams of all words are ordered by frequency, rare ones first (at most 90
letters, so at most 8,100 bigrams: a table of proven size). One inserted, deleted or replaced letter spoils at most two bigrams of a word, so
two near words share one of their three rarest, moved by no more than their difference in length. As the letter lies either after that
bigram or before it, all that stands on the other side is equal too: the join key is the bigram with that whole side and the length of the
shorter word. Pairs that meet are verified by their edit distance.

A key under which more than ``LIMIT`` words meet is not paired out: its words are keyed again by what is left of them when one letter more is
taken away (its place and the rest for words of one length, the rest alone for a longer word and a shorter one), which only near words share.

Defined cases: a null or empty text has no words; texts are counted whole, however long; a null key counts as the empty text in the hash of
``typos``; repeated rows count as often as they stand; ties of forms go to the first word in code-point order; an empty table gives no rows;
columns other than the key and the text are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.arrow import arrow_pass
from emberline.operators.skew import BROADCAST_BYTES, bytes_of
from emberline.session import forget, table, written

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Words under one key up to which they are paired; beyond it the key is split.
LIMIT = 64
#: Distinct words that a task holds before it hands their counts on.
HELD = 200_000
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def runs(text: str) -> dict[str, int]:
    """The runs of letters of a text, A to Z lower-cased, with their counts."""
    found = RUN.findall(text) if len(text) < 1 << 20 else (m.group() for m in RUN.finditer(text))
    out: dict[str, int] = {}
    for w, n in Counter(found).items():
        w = w.lower() if w.isascii() else w.translate(_LOWER)
        out[w] = out.get(w, 0) + n
    return out


def vocabulary(docs: DataFrame, text: str = "text", key: str = "doc_id", least_length: int = 5, least_count: int = 3, typos: int | None = None) -> DataFrame:
    """(word, n) of all texts. With ``typos``, a word whose crc32 of "key:word" is a multiple of it loses the letter at that number modulo its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return made

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = crc32(f"{key or ''}:".encode())
                for w, n in runs(text).items():
                    if typos and (h := crc32(w.encode(), seed)) % typos == 0:
                        at = h % len(w)
                        w = w[:at] + w[at + 1 :]
                    if len(w) >= least_length:
                        held[w] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    parts = arrow_pass(docs.select(F.col(key).cast("string").alias("k"), F.col(text).cast("string").alias("t")), run, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram when all are ordered by the number of words' places that hold it, the rarest first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for b in batches:
            for w in b.column(0).to_pylist():
                counts.update(map("".join, zip(w, w[1:])))
        yield pa.RecordBatch.from_pydict({"gram": pa.array(list(counts), pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    found = arrow_pass(words.select("word"), run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {g: i for i, (g, _) in enumerate(sorted(found.collect(), key=lambda r: (r["n"], r["gram"])))}


def entries(words: DataFrame, order: dict[str, int]) -> DataFrame:
    """A row per word, rare bigram, side and length of the shorter word: (key, short, after, at, id, word, n); ``short``: the word has that length."""
    held = words.sparkSession.sparkContext.broadcast(order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = held.value
        for b in batches:
            for first in range(0, b.num_rows, 20_000):
                part = b.slice(first, 20_000)
                rows, keys, short, after, where = [], [], [], [], []
                for r, w in enumerate(part.column(1).to_pylist()):
                    size = len(w)
                    for _, at in heapq.nsmallest(3, ((place[w[i : i + 2]], i) for i in range(size - 1))):
                        for is_after, side in ((True, w[: at + 2]), (False, w[at:])):
                            for m in (size, size - 1):
                                rows.append(r)
                                keys.append(_signed(xxhash.xxh3_64_intdigest(f"{is_after:d}{m}:{side}".encode())))
                                short.append(m == size)
                                after.append(is_after)
                                where.append(at)
                own = part.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(short, pa.bool_()), pa.array(after, pa.bool_()), pa.array(where, pa.int32()), *own.columns], ["key", "short", "after", "at", "id", "word", "n"])

    return arrow_pass(words.select("id", "word", "n"), run, "key long, short boolean, after boolean, at int, id long, word string, n long")


def without_each(rest: str) -> list[int]:
    """A hash of ``rest`` as it is, and of it without each of its letters: equal strings have equal hashes."""
    powers, lefts = [1], [0]
    for c in rest:
        powers.append(powers[-1] * _BASE % _PRIME)
        lefts.append((lefts[-1] * _BASE + ord(c)) % _PRIME)
    out = [lefts[-1]]
    right = 0
    for i in range(len(rest) - 1, -1, -1):
        k = len(rest) - 1 - i  # letters to the right of this one
        out.append((lefts[i] * powers[k] + right) % _PRIME)
        right = (right + ord(rest[i]) * powers[k]) % _PRIME
    return out


def split(rows: DataFrame) -> DataFrame:
    """(key, short, id): entries of crowded keys, keyed again by the side on which their words differ."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, short, ids = [], [], []

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pydict({"key": pa.array(keys, pa.int64()), "short": pa.array(short, pa.bool_()), "id": pa.array(ids, pa.int64())})
            for held in (keys, short, ids):
                held.clear()
            return made

        for b in batches:
            for key, is_short, after, at, i, w in zip(*(b.column(c).to_pylist() for c in range(6)), strict=True):
                whole, *less = without_each(w[at + 2 :] if after else w[:at])
                if is_short:  # as the shorter of two words, and as one of two of equal length that differ at one place
                    new = [(True, f"{key}={whole}"), *((True, f"{key}@{p}={h}") for p, h in enumerate(less))]
                else:
                    new = [(False, f"{key}={h}") for h in set(less)]
                for s, k in new:
                    keys.append(_signed(xxhash.xxh3_64_intdigest(k.encode())))
                    short.append(s)
                    ids.append(i)
                if len(keys) > 100_000:
                    yield out()
        yield out()

    return arrow_pass(rows.select("key", "short", "after", "at", "id", "word"), run, "key long, short boolean, id long")


def _met(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Pairs of rows of one key, of which the first has the shorter length."""
    a = rows.where("short").select("key", *[F.col(c).alias(f"a_{c}") for c in columns])
    b = rows.select("key", "short", *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b.hint("shuffle_merge"), "key").where("not short or a_id < b_id")


def near_pairs(words: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(a, n_a, b, n_b): each pair of near words once. ``words`` is a written table (id, word, n)."""
    keyed = written(entries(words, bigram_order(words)), "entries")
    crowded = written(keyed.groupBy("key").count().where(F.col("count") > limit).select("key"), "crowded")
    near = F.levenshtein("a_word", "b_word", 1) == 1
    hint = "broadcast" if bytes_of(crowded) <= BROADCAST_BYTES else "shuffle_merge"
    out = _met(keyed.join(crowded.hint(hint), "key", "left_anti"), ["id", "word", "n"]).where(near).select("a_word", "a_n", "b_word", "b_n")
    hot = _met(split(keyed.join(crowded.hint(hint), "key", "left_semi")), ["id"]).select("a_id", "b_id").distinct()
    for side in "ab":
        hot = hot.join(words.select(F.col("id").alias(f"{side}_id"), F.col("word").alias(f"{side}_word"), F.col("n").alias(f"{side}_n")), f"{side}_id")
    found = out.union(hot.where(near).select(*out.columns))
    made = written(found.groupBy("a_word", "b_word").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n")), "links").select(F.col("a_word").alias("a"), F.col("a_n").alias("n_a"), F.col("b_word").alias("b"), F.col("b_n").alias("n_b"))
    forget(keyed, crowded)
    return made


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of a written table (word, form): where the forms lead. Each round doubles the steps taken."""
    hint = "broadcast" if 2 * bytes_of(forms) <= BROADCAST_BYTES else "shuffle_merge"
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        then = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        step = written(now.join(then.hint(hint), "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        more = not step.where("_moved").isEmpty()
        now = step.select("word", "root")
        if not more:
            return now


def variants(words: DataFrame, times: int = 2, limit: int = LIMIT) -> DataFrame:
    """(word, n, form, root, n_near, form_n) of a table (word, n): a word's form is its near word of largest n if that is ``times`` its own at least."""
    words = written(words.withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pairs = near_pairs(words, limit)
    both = pairs.select(F.col("a").alias("word"), (-F.col("n_b")).alias("m"), F.col("b").alias("other")).union(pairs.select(F.col("b").alias("word"), (-F.col("n_a")).alias("m"), F.col("a").alias("other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("m", "other")).alias("best"))
    led = words.join(best, "word", "left")
    formed = -F.col("best.m") >= times * F.col("n")
    led = written(led.select("word", "n", F.when(formed, F.col("best.other")).alias("form"), F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, -F.col("best.m")).alias("form_n")), "formed")
    ends = roots(led.where("form is not null").select("word", "form"))
    return led.join(ends, "word", "left").select("word", "n", "form", F.coalesce("root", "word").alias("root"), "n_near", "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents"), typos=97))
