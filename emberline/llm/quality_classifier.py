"""Quality by logistic regression on hashed word n-grams, trained with follow-the-regularised-leader updates.

Words and runs of marks, one by one and in pairs, are hashed into 2^``BITS`` places, and so are their shapes (case, length, marks as they
are, and whether a word repeats the one before). A text is the logarithms of its counts, scaled to length 1; its score the logistic value of
the sparse dot product with the weights.

Training takes at most ``FIT_ROWS`` labelled rows, those of least hash of the key: a documented bound. They are dealt over ``SHARDS`` tasks by
their hash; each goes over its rows ``EPOCHS`` times, in order of their hash, updating the leader's sums, and the leaders are averaged by tasks of
their own, slice by slice: what reaches the driver is one table of 2^``BITS`` weights, however many rows there are. Every row is scored.

Defined cases: a null or empty text has no n-grams and gets the value of the constant alone; texts are read whole, however long; a null label
is no label; several labels of one document count as their maximum; a null key has no label and is not held out; rows equal in key and text are
learned from once; without labels every score is 0.5; equal texts get equal scores; a score at the threshold counts as good; an empty table
gives no rows; columns other than the key and the text are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.arrow import arrow_pass
from emberline.operators.skew import grouped_pass, small_or_shuffled
from emberline.session import forget, table, written

BITS, FIT_ROWS, SHARDS, SLICES, EPOCHS, THRESHOLD = 18, 20_000, 8, 16, 4, 0.3
#: Of the updates: step size, its offset, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 3.0, 1.0, 0.0, 0.1
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_MIX, _TURN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Hashes that a task remembers.
_KNOWN = 300_000


def shape(token: str) -> str:
    """Case and length of a word, a quarter of its letters at a time; a run of marks as it begins."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:4]
    case = "U" if len(token) > 1 and token.isupper() else "T" if token[0].isupper() else "d" if token.isdigit() else "l"
    return f"{case}{min(len(token), 16) // 4}"


class Features:
    """Sparse features of texts; remembers the hashes of tokens."""

    def __init__(self, bits: int = BITS):
        self.bits, self.known = bits, {}

    def _hashes(self, token: str) -> tuple[int, int]:
        if len(self.known) > _KNOWN:
            self.known.clear()
        own = self.known[token] = (xxhash.xxh3_64_intdigest(token.encode("utf-8", "surrogatepass")), xxhash.xxh3_64_intdigest(b"~" + shape(token).encode("utf-8", "surrogatepass")))
        return own

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The places that a text's n-grams fall on, ascending, and their values."""
        tokens = _TOKEN.findall(text or "")
        if not tokens:
            return np.zeros(0, np.int64), np.zeros(0)
        known = self.known
        pairs = np.array([known.get(t) or self._hashes(t) for t in tokens], np.uint64)
        words, shapes = pairs[:, 0], pairs[:, 1]
        with np.errstate(over="ignore"):
            again = np.concatenate([[False], words[1:] == words[:-1]])
            shapes = np.where(again, shapes * _MIX + np.uint64(7), shapes)
            grams = np.concatenate([words, words[:-1] * _MIX ^ words[1:] * _TURN, shapes, shapes[:-1] * _MIX ^ shapes[1:] * _TURN])
            grams = (grams ^ grams >> np.uint64(29)) * _TURN
        at, counts = np.unique((grams ^ grams >> np.uint64(32)) & np.uint64((1 << self.bits) - 1), return_counts=True)
        values = np.log1p(counts)
        return at.astype(np.int64), values / np.sqrt(values @ values)


def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The leader for the sums of slopes ``z`` and of their squares ``n``."""
    return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def follow(z: np.ndarray, n: np.ndarray, rows: Iterator[tuple[np.ndarray, np.ndarray, float]]) -> None:
    """Update the sums, in place, by rows of places, values and labels; the last place is the constant's."""
    for at, values, y in rows:
        at, values = np.append(at, len(z) - 1), np.append(values, 1.0)
        z_at, n_at = z[at], n[at]
        w = weights(z_at, n_at)
        slope = (logistic(w @ values) - y) * values
        z[at] = z_at + slope - (np.sqrt(n_at + slope * slope) - np.sqrt(n_at)) / ALPHA * w
        n[at] = n_at + slope * slope


def _averaged(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The mean of each slice over its copies."""
    for a, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
        own = t.slice(a, e - a)
        mean = sum(np.frombuffer(x) for x in own.column("weights").to_pylist()) / (e - a)
        yield pa.RecordBatch.from_pydict({"slice": own.column("slice").slice(0, 1).combine_chunks(), "weights": pa.array([mean.tobytes()], pa.binary())})


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "quality", learned: Column | None = None, bits: int = BITS, fit_rows: int = FIT_ROWS, epochs: int = EPOCHS) -> np.ndarray:
    """Weights, the constant's last. ``learned`` (of the labels' columns) tells which labels may be learned from."""
    known = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & (F.lit(True) if learned is None else learned))
    known = known.groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("y")).withColumn("h", F.xxhash64("_k"))
    rows = docs.select(F.col(key).alias("_k"), F.col(text).cast("string").alias("t"), F.xxhash64(F.col(text).cast("string")).alias("th"))
    # rows are chosen by narrow keys; texts stay where they are
    chosen = written(rows.select("_k", "th").join(small_or_shuffled(known), "_k").distinct().orderBy("h", "_k", "th").limit(fit_rows), "chosen")
    picked = rows.join(F.broadcast(chosen), ["_k", "th"]).select(F.pmod("h", F.lit(SHARDS)).cast("int").alias("shard"), "h", "th", "y", "t").dropDuplicates(["h", "th"])

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        made = Features(bits)
        for a, e in zip(starts, [*starts[1:], t.num_rows], strict=True):
            own = t.slice(a, e - a)
            seen = [(*made.of(x), y) for x, y in zip(own.column("t").to_pylist(), own.column("y").to_pylist(), strict=True)]
            z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
            for _ in range(epochs):
                follow(z, n, iter(seen))
            parts = [w.tobytes() for w in np.array_split(weights(z, n), SLICES)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array(range(SLICES), pa.int32()), "shard": pa.array(own.column("shard").to_pylist()[:1] * SLICES, pa.int32()), "weights": pa.array(parts, pa.binary())})

    leaders = grouped_pass(picked, "shard", ["h", "th"], run, "slice int, shard int, weights binary")
    parts = sorted(grouped_pass(leaders, "slice", ["shard"], _averaged, "slice int, weights binary").collect())
    forget(chosen)
    return np.concatenate([np.frombuffer(r["weights"]) for r in parts]) if parts else np.zeros((1 << bits) + 1)


def scored(docs: DataFrame, model: np.ndarray, keep: list[str], text: str = "text", score: str = "score") -> DataFrame:
    """The columns ``keep`` and the score of each row."""
    held, bits, kinds = docs.sparkSession.sparkContext.broadcast(model), int(len(model) - 1).bit_length() - 1, dict(docs.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, w = Features(bits), held.value
        for b in batches:
            found = (made.of(t) for t in b.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array([float(logistic(w[at] @ values + w[-1])) for at, values in found], pa.float64())], [*keep, score])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + [f"`{score}` double"])
    return arrow_pass(docs.select(*keep, F.col(text).cast("string").alias("_text")), run, schema)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    model = train(docs, table(spark, sf_dir, "labels"), learned=~out)
    return scored(docs, model, ["doc_id"]).select("doc_id", F.coalesce(out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
