"""Hard negatives by product quantisation with stored residual norms.

Vectors are whole numbers. Pairs of components are quantised to the nearest of 256 whole centroids; a row keeps its codes, its vector and the
norm of what the codes miss. Rows lie in blocks of some thousands, sorted by label; anchors in blocks of their own; every block of anchors
meets every block of rows, one pair of blocks at a time: a task reads some files of each, and neither side is sent to the driver, to all or through
a shuffle, as anchors times blocks grow with the square of the table. Within a pair, lookup tables give the score of anchor and centroids, exact in whole
numbers; the true score lies within the product of the anchor's norm and the residual's norm of it. Only rows whose interval can reach the
best of a block (positives) or a window (negatives) are scored exactly. What a pair of blocks yields is its best few rows per anchor, which
tasks merge over their blocks and windows over tasks; thus the result is exact whatever the centroids are.

The centroids are fitted to at most ``FIT_ROWS`` rows (those of least hash), the one bound here; every row is quantised.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; missing components of shorter vectors count
as 0; a null key is no anchor, stands last among ties, and takes part otherwise; a repeated row is a row of its own, also beside an anchor that it
repeats; equal scores are ordered by key; a positive of negative score has no window, as its bounds cross; without anchors, or rows of a second label,
there are no rows; columns other than the named ones are not read. Components and their products must fit in 62 bits, else an error says so.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from emberline.llm.arrow import arrow_pass
from emberline.operators.skew import grouped_pass
from emberline.session import forget, table, written

#: Rows that the centroids are fitted to; components that share a code; centroids.
FIT_ROWS, WIDTH, CENTROIDS = 4096, 2, 256
#: Anchors in a block and of a lookup table, and rows in a block at most.
ANCHORS, TABLE, ROWS = 1024, 128, 32_768
_LEAST_ROWS, _CHUNK = 2048, 1024
#: Rows found that a task holds before it gives them on.
MOST_FOUND = 500_000
_FAR = np.iinfo(np.int64).max // 2
_I8 = np.dtype("<i8")


def whole_vectors(rows: DataFrame, vector: str, label: str, key: str, times: int = 256) -> DataFrame:
    """(key, label, v) of the rows that take part; components become floor(``times`` * x)."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(label).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    return rows.where(fine).select(F.col(key).cast("long").alias("key"), F.col(label).cast("long").alias("label"), F.transform(v, lambda x: F.floor(x * times).cast("long")).alias("v"))


def _matrix(v: pa.ListArray, dims: int) -> np.ndarray:
    """Vectors as rows of a matrix, filled up with zeros."""
    out = np.zeros((len(v), dims), np.int64)
    sizes = pa.compute.list_value_length(v).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(v)), sizes), at] = flat
    return out


def _parts(x: np.ndarray) -> np.ndarray:
    """(code, row, component within the code) of a matrix."""
    extra = -x.shape[1] % WIDTH
    return np.pad(x, ((0, 0), (0, extra))).reshape(len(x), -1, WIDTH).transpose(1, 0, 2)


def _nearest(part: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    c = centroids.astype(float)
    return np.concatenate([(np.square(c).sum(1) - 2 * part[i : i + 4096].astype(float) @ c.T).argmin(1) for i in range(0, max(1, len(part)), 4096)])


def fit_centroids(sample: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Whole centroids of each code, (code, centroid, component): k-means from evenly spaced rows of the sorted sample."""
    out = []
    for part in _parts(sample):
        seen = np.unique(part, axis=0)
        c = seen[np.linspace(0, len(seen) - 1, CENTROIDS).astype(int)].astype(float)
        for _ in range(rounds):
            own = _nearest(part, c)
            n = np.bincount(own, minlength=CENTROIDS)
            sums = np.stack([np.bincount(own, part[:, k], CENTROIDS) for k in range(WIDTH)], 1)
            c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        out.append(np.rint(c).astype(np.int64))
    return np.stack(out) if out else np.zeros((0, CENTROIDS, WIDTH), np.int64)


def _row_blocks(rows: DataFrame, centroids, dims: int, blocks: int) -> DataFrame:
    """A row per block of rows: ids, keys, labels, codes, residual norms and vectors, sorted by label."""

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
            own = t.slice(a, z - a).combine_chunks()
            x = _matrix(own.column("v").chunk(0), dims)
            codes = np.zeros((len(x), len(centroids.value)), np.uint8)
            missed = np.zeros(len(x))
            for s, (part, c) in enumerate(zip(_parts(x), centroids.value, strict=True)):
                codes[:, s] = _nearest(part, c)
                missed += np.square((part - c[codes[:, s]]).astype(float)).sum(1)
            keys = own.column("key")
            cells = {"n": z - a, "ids": own.column("id").to_numpy(), "keys": keys.fill_null(0).to_numpy(), "nulls": keys.is_null().to_numpy().astype(np.int64), "labels": own.column("label").to_numpy(), "codes": codes, "norms": np.sqrt(missed) * (1 + 1e-9), "vectors": x}
            yield pa.RecordBatch.from_pydict({"block": pa.array([own.column("block")[0].as_py()], pa.int32()), **{k: pa.array([int(v)], pa.int32()) if k == "n" else pa.array([v.tobytes()], pa.binary()) for k, v in cells.items()}})

    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return grouped_pass(dealt.select("block", "id", "key", "label", "v"), "block", ["label", "id"], run, "block int, n int, ids binary, keys binary, nulls binary, labels binary, codes binary, norms binary, vectors binary")


class _Block:
    """Rows of a block as arrays."""

    def __init__(self, row: dict, dims: int):
        get = lambda k, kind=_I8: np.frombuffer(row[k], kind)
        self.n, self.ids, self.keys, self.nulls, self.labels, self.norms = row["n"], get("ids"), get("keys"), get("nulls"), get("labels"), get("norms", "<f8")
        self.codes = get("codes", np.uint8).reshape(self.n, -1)
        self.vectors = get("vectors").reshape(self.n, dims)

    def best(self, scores: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
        """The places, among ``at``, of the best ``most`` rows: by score, then key, null keys last."""
        if len(at) > most:  # ties at the last score are kept for the order by key
            last = np.partition(scores, len(scores) - most)[len(scores) - most]
            keep = scores >= last
            scores, at = scores[keep], at[keep]
        order = np.lexsort((self.keys[at], self.nulls[at], -scores))[:most]
        return at[order], scores[order]


def _lookup(anchors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(code, centroid, anchor): the part of the score that each code stands for."""
    return np.einsum("scw,saw->sca", centroids, _parts(anchors)) if len(centroids) else np.zeros((0, CENTROIDS, len(anchors)), np.int64)


def _approximate(codes: np.ndarray, tables: np.ndarray) -> np.ndarray:
    """(anchor, row): scores of the centroids, summed over lookups."""
    out = np.zeros((tables.shape[2], len(codes)), np.int64)
    for a in range(0, len(codes), _CHUNK):
        part = np.zeros((len(codes[a : a + _CHUNK]), tables.shape[2]), np.int64)
        for s, t in enumerate(tables):
            part += t[codes[a : a + _CHUNK, s]]
        out[:, a : a + _CHUNK] = part.T
    return out


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x.astype(float)).sum(1)) * (1 + 1e-9)


def _anchor_blocks(anchors: DataFrame, dims: int, blocks: int, windows: bool) -> DataFrame:
    """A row per block of anchors: ids, labels, vectors and, with ``windows``, the lowest and highest score of each window."""
    names = ["low", "high"] if windows else []

    def run(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for a, z in zip(starts, [*starts[1:], t.num_rows], strict=True):
            own = t.slice(a, z - a).combine_chunks()
            cells = {"anchor_ids": own.column("id").to_numpy(), "anchor_labels": own.column("label").to_numpy(), "anchor_vectors": _matrix(own.column("v").chunk(0), dims)}
            made = {"own": pa.array([own.column("own")[0].as_py()], pa.int32()), "anchors": pa.array([z - a], pa.int32()), **{k: pa.array([v.tobytes()], pa.binary()) for k, v in cells.items()}}
            yield pa.RecordBatch.from_pydict(made | {k: pa.array([own.column(k).to_pylist()], pa.list_(pa.list_(pa.int64()))) for k in names})

    dealt = anchors.withColumn("own", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).select("own", "id", "label", "v", *names)
    return grouped_pass(dealt, "own", ["id"], run, "own int, anchors int, anchor_ids binary, anchor_labels binary, anchor_vectors binary" + "".join(f", {n} array<array<bigint>>" for n in names))


def _meeting(row_blocks: DataFrame, anchor_blocks: DataFrame, fn, by: list[str], most: int) -> DataFrame:
    """``fn`` on every pair of a block of anchors and a block of rows; of what a task finds, the best ``most`` rows for each of ``by``."""
    # every file of rows meets every file of anchors where it is read: a join on the block's number would send all anchors along once per block
    pairs = row_blocks.hint("shuffle_replicate_nl").crossJoin(anchor_blocks)
    names = [*by, "key", "is_null", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for row in b.to_pylist():
                new = fn(row)
                held[row["own"]] = _best_rows([np.concatenate(c) for c in zip(held[row["own"]], new, strict=True)], len(by), most) if row["own"] in held else new
            if sum(len(c[0]) for c in held.values()) > MOST_FOUND:
                yield from (pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names) for c in held.values())
                held = {}
        yield from (pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in c], names) for c in held.values())

    return arrow_pass(pairs, run, ", ".join(f"{n} long" for n in names))


def _best_rows(found: list[np.ndarray], by: int, most: int) -> list[np.ndarray]:
    """The best ``most`` rows of columns (the first ``by`` of them, key, is_null, score) for each value of the first ``by``, as :func:`_ranked` orders them."""
    *groups, key, is_null, score = found
    order = np.lexsort((key, is_null, -score, *reversed(groups)))
    found = [c[order] for c in found]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in found[:by]:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    place = np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)]))
    return [c[place < most] for c in found]


def _positives(centroids, dims: int, most: int):
    def fn(row: dict) -> list[np.ndarray]:
        block = _Block(row, dims)
        ids, labels = np.frombuffer(row["anchor_ids"], _I8), np.frombuffer(row["anchor_labels"], _I8)
        vectors = np.frombuffer(row["anchor_vectors"], _I8).reshape(row["anchors"], dims)
        found: list[list] = [[], [], [], []]
        for label in np.unique(labels):
            a, z = np.searchsorted(block.labels, [label, label + 1])
            own = np.flatnonzero(labels == label)
            for first in range(0, len(own) if z > a else 0, TABLE):
                some = own[first : first + TABLE]
                guess = _approximate(block.codes[a:z], _lookup(vectors[some], centroids.value))
                off = np.ceil(np.outer(_norms(vectors[some]), block.norms[a:z])).astype(np.int64)
                for i, g, o in zip(some, guess, off, strict=True):
                    itself = block.ids[a:z] == ids[i]
                    low = np.where(itself, -_FAR, g - o)
                    least = np.partition(low, len(low) - most)[len(low) - most] if len(low) > most else -_FAR
                    at = a + np.flatnonzero((g + o >= least) & ~itself)
                    at, scores = block.best(block.vectors[at] @ vectors[i], at, most)
                    for held, new in zip(found, (np.full(len(at), ids[i]), block.keys[at], block.nulls[at], scores), strict=True):
                        held.append(new)
        return _columns(found)

    return fn


def _negatives(centroids, dims: int, most: int):
    def fn(row: dict) -> list[np.ndarray]:
        block = _Block(row, dims)
        ids, labels = np.frombuffer(row["anchor_ids"], _I8), np.frombuffer(row["anchor_labels"], _I8)
        vectors = np.frombuffer(row["anchor_vectors"], _I8).reshape(row["anchors"], dims)
        found: list[list] = [[], [], [], [], []]
        for first in range(0, len(ids), TABLE):
            some = range(first, min(first + TABLE, len(ids)))
            guess = _approximate(block.codes, _lookup(vectors[some], centroids.value))
            off = np.ceil(np.outer(_norms(vectors[some]), block.norms)).astype(np.int64)
            for i, g, o in zip(some, guess, off, strict=True):
                a, z = np.searchsorted(block.labels, [labels[i], labels[i] + 1])
                low, high = g - o, g + o
                low[a:z], high[a:z] = _FAR, -_FAR  # rows of the anchor's own label lie in no window
                # only rows that can lie in some window are looked at again
                near = np.flatnonzero((high >= min(row["low"][i])) & (low <= max(row["high"][i])))
                low, high = low[near], high[near]
                scores = np.full(len(near), -_FAR)
                known = np.zeros(len(near), bool)
                for w, (least, greatest) in enumerate(zip(row["low"][i], row["high"][i], strict=True)):
                    if least > greatest:
                        continue
                    sure = low[(low >= least) & (high <= greatest)]
                    reach = max(least, np.partition(sure, len(sure) - most)[len(sure) - most]) if len(sure) >= most else least
                    at = np.flatnonzero((high >= reach) & (low <= greatest))
                    new = at[~known[at]]
                    scores[new] = block.vectors[near[new]] @ vectors[i]
                    known[new] = True
                    at = at[(scores[at] >= least) & (scores[at] <= greatest)]
                    at, own = block.best(scores[at], near[at], most)
                    for held, n in zip(found, (np.full(len(at), ids[i]), np.full(len(at), w), block.keys[at], block.nulls[at], own), strict=True):
                        held.append(n)
        return _columns(found)

    return fn


def _columns(found: list[list]) -> list[np.ndarray]:
    return [np.concatenate([np.zeros(0, np.int64), *c]) for c in found]


def _ranked(found: DataFrame, by: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "is_null", "key")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).withColumn("key", F.when(F.col("is_null") == 0, F.col("key")))


def hard_negatives(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_rows: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (key, label, v), v whole numbers.

    An anchor's positives are its best rows of the same label; each one's negatives the best rows of other labels whose score lies between
    ``low`` and ``high`` per cent of its own. ``block_rows`` is for tests; by default blocks grow with the table, up to ``ROWS``.
    """
    spark = rows.sparkSession
    rows = written(rows.select("key", "label", "v", F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), F.monotonically_increasing_id().alias("id")), "vectors")
    size = F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))
    total, dims, largest, n_anchors = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(size), F.lit(0)), F.coalesce(F.sum(F.col("is_anchor").cast("int")), F.lit(0))).first()
    if 4 * max(1, dims) * largest**2 >= 1 << 62:
        raise ValueError(f"products of components up to {largest} in {dims} dimensions do not fit in 62 bits")
    sample = rows.orderBy(F.xxhash64("v"), "id").limit(FIT_ROWS).select("v").toArrow()
    whole = _matrix(sample.column("v").combine_chunks(), dims) if sample.num_rows else np.zeros((1, dims), np.int64)
    centroids = spark.sparkContext.broadcast(fit_centroids(whole))
    blocks = max(1, math.ceil(total / (block_rows or min(ROWS, max(_LEAST_ROWS, total // 32)))))
    stored = written(_row_blocks(rows, centroids, dims, blocks), "blocks")
    anchors = rows.where("is_anchor").select("id", F.col("key").alias("anchor_id"), "label", "v")
    groups = max(1, math.ceil(n_anchors / ANCHORS))
    found = _meeting(stored, written(_anchor_blocks(anchors, dims, groups, False), "anchors"), _positives(centroids, dims, positives), ["id"], positives)
    near = written(_ranked(found, ["id"], positives).select("id", "place", F.col("key").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # 50 p <= 100 n <= 95 p, in whole scores
    bounds = near.select("id", "place", F.expr(f"(({low} * positive_score) - pmod({low} * positive_score, 100)) div 100 + if(pmod({low} * positive_score, 100) > 0, 1, 0)").alias("least"), F.expr(f"(({high} * positive_score) - pmod({high} * positive_score, 100)) div 100").alias("most"))
    lists = bounds.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "least", "most"))).alias("w")).select("id", F.col("w.least").alias("low"), F.col("w.most").alias("high"))
    framed = _anchor_blocks(anchors.join(lists, "id"), dims, groups, True)
    found = _meeting(stored, written(framed, "windows"), _negatives(centroids, dims, negatives), ["id", "window"], negatives)
    last = _ranked(found, ["id", "window"], negatives).select("id", (F.col("window") + 1).cast("int").alias("place"), F.col("place").alias("rank"), F.col("key").alias("negative_id"), F.col("score").alias("negative_score"))
    out = last.join(near, ["id", "place"]).join(anchors.select("id", "anchor_id"), "id")
    out = written(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"), "negatives")
    forget(rows, stored, near)
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = whole_vectors(rows.select("vec_id", "embedding", label.alias("label")), "embedding", "label", "vec_id")
    return hard_negatives(whole, F.col("key") % 50 == 0)
