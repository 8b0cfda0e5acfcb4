"""N-gram Jaccard join by chosen paths.

A document is the set of its runs of five words. Documents with one set form one class member and are joined once. A set's MinHash
values are its sampled tokens: a path from the root picks two positions per node (by a hash of the node) and goes on to the child named by
position and value, so sets that share sampled tokens meet again. Two levels are chosen without looking at the data; a node that then
holds more than ``LIMIT`` sets is split further, unless its sets are so alike that splitting would not help: these, and nodes at the last
level, are compared block by block. Runs are repeated until the target recall. In a node two sets are candidates if their sizes allow the
similarity and enough sampled tokens are equal; what candidates connect is handed on as stars: no pair list of a group is ever made.

Sets that candidates connect are intersected exactly. Where these are more than ``BLOCK``, they are dealt into blocks and pairs of blocks
are first compared by sampled tokens, so that a set's body goes only to pairs of blocks in which it has a candidate: a long chain costs its
candidates, not its square. The links found (similarity of at least 0.8) are counted, and classes are what links connect.

Within a class, all candidates are intersected: that is what counting its links takes. Copies cost nothing beyond their membership.

Defined cases: words are runs of characters other than space and 9 to 13; a text of one to four words is one run, whole texts count,
however long; a null or empty text has no runs, no links, no copies and a class of its own; null ids come last in a class; equal rows are
copies of one another; ties of least id go to the least hash of the row; an empty table gives no rows; columns other than key and text are
kept by ``deduplicated`` whatever their names, and ignored by ``classes``. Names of graph nodes are 64-bit hashes of whole sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.arrow import arrow_pass
from emberline.operators.components import connected_components
from emberline.operators.skew import grouped_pass, join_on_hot_key, small_or_shuffled
from emberline.session import forget, table, written

WORDS, SIMILARITY, RECALL = 5, 0.8, 0.99
POSITIONS, CHOSEN, LIMIT, DEPTH = 96, 2, 1024, 6
#: Estimated similarity from which two sets of a node become candidates: 3.5 standard deviations below the threshold.
CANDIDATE = SIMILARITY - 3.5 * math.sqrt(SIMILARITY * (1 - SIMILARITY) / POSITIONS)
#: Share of equal sampled tokens in a node from which it is compared in blocks.
DENSE = 0.3
#: Sets of one component that are intersected in one block.
BLOCK = 128

_RANDOM = np.random.default_rng(20)
_TIMES = _RANDOM.integers(0, 2**63, POSITIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 2**63, POSITIONS, dtype=np.uint64)
_ROLL = _RANDOM.integers(0, 2**63, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def runs_for(recall: float = RECALL, similarity: float = SIMILARITY, depth: int = 2) -> int:
    """Runs after which a pair of that similarity has met with the target probability."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - similarity * p) ** CHOSEN
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: bytes | None, known: WordHashes, n: int = WORDS) -> np.ndarray:
    """The sorted set of hashes of the runs of ``n`` words."""
    words = text.split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter([known[x] for x in words], np.uint64, len(words))
    k = min(n, len(w))
    total = np.full(len(w) - k + 1, k, np.uint64)
    for i in range(k):
        total = total + w[i : len(w) - k + 1 + i] * _ROLL[i]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    least = np.full(POSITIONS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(s), 4096):
        np.minimum(least, (s[a : a + 4096, None] * _TIMES + _PLUS).min(0), out=least)
    return (_mix(least) >> np.uint64(48)).astype(np.uint16)


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _signed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, rid, s, sig, size): s names the set, size counts its runs; null without words."""
    kind = dict(docs.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            sets = [shingles(t, known) for t in _texts(b.column(2))]
            names = [np.array(xxhash.xxh64_intdigest(s.tobytes()), np.uint64).astype(np.int64).item() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.int64()), pa.array([signature(s).tobytes() if len(s) else None for s in sets], pa.binary()), pa.array([len(s) or None for s in sets], pa.int32())], [key, "rid", "s", "sig", "size"])

    return arrow_pass(docs.select(key, F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(text).cast("string")), run, f"`{key}` {kind}, rid long, s long, sig binary, size int")


def _children(nodes: np.ndarray, sigs: np.ndarray) -> np.ndarray:
    """The ``CHOSEN`` children of each node for its set: positions are sampled by the node, without replacement."""
    first = _mix(nodes) % np.uint64(POSITIONS)
    step = _mix(nodes ^ np.uint64(0x5DEECE66D)) % np.uint64(POSITIONS - 1) + np.uint64(1)
    out = np.empty((len(nodes), CHOSEN), np.uint64)
    for j in range(CHOSEN):
        at = ((first + np.uint64(j) * step) % np.uint64(POSITIONS)).astype(np.int64)
        out[:, j] = _mix(_mix(nodes + np.uint64(j + 1)) ^ (at.astype(np.uint64) << np.uint64(32)) ^ sigs[np.arange(len(nodes)), at].astype(np.uint64))
    return out


def _sig_array(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, POSITIONS)


def _paths(sets: DataFrame, runs: int, depth: int = 2) -> DataFrame:
    """(node, s, sig, size) for each set and chosen path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = _sig_array(b.column(1))
            nodes, of = np.tile(np.arange(1, runs + 1, dtype=np.uint64), len(sigs)), np.repeat(np.arange(len(sigs)), runs)
            for _ in range(depth):
                nodes, of = _children(nodes, sigs[of]).ravel(), np.repeat(of, CHOSEN)
            rows = b.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([pa.array(nodes.astype(np.int64)), *rows.columns], ["node", "s", "sig", "size"])

    return arrow_pass(sets.select("s", "sig", "size"), run, "node long, s long, sig binary, size int")


def _deeper(rows: DataFrame) -> DataFrame:
    """(parent, node, s, sig, size): the rows of large nodes with the children that they go to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parents = b.column(0).to_numpy()
            nodes = _children(parents.astype(np.uint64), _sig_array(b.column(2))).ravel()
            of = np.repeat(np.arange(len(parents)), CHOSEN)
            again = b.take(pa.array(of))
            yield pa.RecordBatch.from_arrays([again.column(0), pa.array(nodes.astype(np.int64)), again.column(1), again.column(2), again.column(3)], ["parent", "node", "s", "sig", "size"])

    return arrow_pass(rows.select("node", "s", "sig", "size"), run, "parent long, node long, s long, sig binary, size int")


def _in_blocks(rows: DataFrame, group: str, count: str, size: int) -> DataFrame:
    """The rows once for each pair of blocks that theirs takes part in: columns key, own, other."""
    k = F.ceil(F.col(count) / size).cast("int")
    own = F.pmod(F.xxhash64("s", F.lit(7)), k).cast("int")
    return rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), k - 1))).withColumn("key", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other")))


def _labels(near: np.ndarray) -> np.ndarray:
    """Component numbers of a symmetric boolean matrix: the least index that is reachable."""
    n = len(near)
    label = np.full(n, -1)
    for i in range(n):
        if label[i] < 0:
            front = np.zeros(n, bool)
            front[i] = True
            while front.any():
                label[front] = i
                front = near[front].any(0) & (label < 0)
    return label


def _near(sigs: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Which sets of a group are candidates: their sizes allow the similarity and enough sampled tokens are equal."""
    m = len(sigs)
    near = np.empty((m, m), bool)
    for i in range(0, m, 64):
        near[i : i + 64] = (sigs[i : i + 64, None, :] == sigs[None, :, :]).mean(2) >= CANDIDATE
    return near & (np.minimum.outer(sizes, sizes) >= SIMILARITY * np.maximum.outer(sizes, sizes) - 1e-9)


def _stars(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Candidate stars of whole nodes."""
    s, sizes, sigs = t.column("s").to_numpy(), t.column("size").to_numpy().astype(np.float64), None
    ends = np.append(starts[1:], len(s))
    a, b = [], []
    for lo, hi in zip(starts, ends, strict=True):
        if hi - lo < 2:
            continue
        if sigs is None:
            sigs = _sig_array(t.column("sig"))
        label = _labels(_near(sigs[lo:hi], sizes[lo:hi]))
        other = (label != np.arange(hi - lo)) & (s[lo + label] != s[lo:hi])
        a += list(s[lo + label[other]])
        b += list(s[lo:hi][other])
    if a:
        yield pa.RecordBatch.from_pydict({"src": pa.array(a, pa.int64()), "dst": pa.array(b, pa.int64())})


def _meeting(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(key, s, own, other): the sets that have a candidate in their pair of blocks."""
    own, other, sizes, sigs = t.column("own").to_numpy(), t.column("other").to_numpy(), t.column("size").to_numpy().astype(np.float64), _sig_array(t.column("sig"))
    for lo, hi in zip(starts, np.append(starts[1:], len(own)), strict=True):
        near = _near(sigs[lo:hi], sizes[lo:hi])
        np.fill_diagonal(near, False)
        if (own[lo:hi] != other[lo:hi]).any():  # two different blocks: pairs within one are another task's
            near &= own[lo:hi][:, None] != own[lo:hi][None, :]
        stay = lo + np.flatnonzero(near.any(1))
        if len(stay):
            yield from t.take(pa.array(stay)).select(["key", "s", "own", "other"]).to_batches()


def candidates(sets: DataFrame, recall: float = RECALL) -> DataFrame:
    """(src, dst): stars that connect the sets of each candidate component."""
    rows = _paths(sets, runs_for(recall))
    counts = lambda r: written(r.groupBy("node").agg(F.count("*").alias("m")).where(F.col("m") > LIMIT), "large")
    large = counts(rows)
    if large.limit(1).count() == 0:
        return grouped_pass(rows.select("node", "s", "sig", "size"), "node", [], _stars, "src long, dst long")
    calm = rows.join(small_or_shuffled(large.select("node")), "node", "left_anti").select("node", "s", "sig", "size")
    out = [grouped_pass(calm, "node", [], _stars, "src long, dst long")]
    open_rows = written(rows.join(small_or_shuffled(large), "node").select("node", "m", "s", "sig", "size"), "open")
    blocks = []
    for _ in range(2, DEPTH):
        below = _deeper(open_rows)
        sizes = below.groupBy("parent", "node").agg(F.count("*").alias("m"))
        alike = sizes.groupBy("parent").agg((F.sum(F.col("m").cast("double") ** 2) / CHOSEN).alias("pairs"), (F.sum("m") / CHOSEN).alias("all")).select("parent", (F.col("pairs") / F.col("all") ** 2 >= DENSE).alias("dense"))
        alike = written(alike, "alike")
        judged = open_rows.join(small_or_shuffled(alike.withColumnRenamed("parent", "node")), "node")
        blocks.append(judged.where("dense").select("node", "m", "s", "sig", "size"))
        sparse = written(below.join(small_or_shuffled(alike.where("not dense").select("parent")), "parent", "left_semi").select("node", "s", "sig", "size"), "sparse")
        large = counts(sparse)
        out.append(grouped_pass(sparse.join(small_or_shuffled(large.select("node")), "node", "left_anti").select("node", "s", "sig", "size"), "node", [], _stars, "src long, dst long"))
        open_rows = written(sparse.join(small_or_shuffled(large), "node").select("node", "m", "s", "sig", "size"), "open")
        if open_rows.limit(1).count() == 0:
            break
    blocks.append(open_rows)
    dense = blocks[0]
    for more in blocks[1:]:
        dense = dense.union(more)
    paired = _in_blocks(dense.dropDuplicates(["node", "s"]), "node", "m", LIMIT // 2).select("key", "s", "sig", "size")
    out.append(grouped_pass(paired, "key", [], _stars, "src long, dst long"))
    result = out[0]
    for more in out[1:]:
        result = result.union(more)
    return result


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, exactly."""
    m = len(sets)
    if m == 2:
        n = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    every = np.concatenate(sets)
    of = np.repeat(np.arange(m), [len(x) for x in sets])
    order = np.argsort(every, kind="stable")
    every, of = every[order], of[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    word = np.cumsum(new) - 1
    shared = np.bincount(word)[word] > 1
    word, of = word[shared], of[shared]
    both = np.diag([float(len(x)) for x in sets])
    diagonal = both.copy()
    both[:] = 0
    if len(word):
        word = np.cumsum(np.concatenate([[True], word[1:] != word[:-1]])) - 1
        width = max(256, (1 << 22) // m)
        for a in range(0, int(word[-1]) + 1, width):
            lo, hi = np.searchsorted(word, [a, a + width])
            grid = np.zeros((m, width), np.float32)
            grid[of[lo:hi], word[lo:hi] - a] = 1
            both += grid @ grid.T
    np.fill_diagonal(both, diagonal.diagonal())
    return np.rint(both).astype(np.int64)


def _linked(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Exact links of whole components or pairs of blocks: per set its local root, its linked sets and the documents that have these."""
    s, own, other, n, raw = t.column("s").to_numpy(), t.column("own").to_numpy(), t.column("other").to_numpy(), t.column("n").to_numpy(), t.column("sh")
    out_s, out_root, out_n, out_docs = [], [], [], []
    for lo, hi in zip(starts, np.append(starts[1:], len(s)), strict=True):
        _, first = np.unique(s[lo:hi], return_index=True)
        at = lo + first
        if len(at) < 2:
            continue
        both = _common([np.frombuffer(raw[int(i)].as_py(), np.uint64) for i in at])
        size = both.diagonal()
        near = both >= SIMILARITY * (size[:, None] + size[None, :] - both) - 1e-9
        np.fill_diagonal(near, False)
        if (own[at] != other[at]).any():  # two different blocks: pairs within one are another task's
            near &= own[at][:, None] != own[at][None, :]
        out_s += list(s[at])
        out_root += list(s[at][_labels(near)])
        out_n += list(near.sum(1))
        out_docs += list(near @ n[at])
    if out_s:
        yield pa.RecordBatch.from_pydict({"s": pa.array(out_s, pa.int64()), "root": pa.array(out_root, pa.int64()), "sets": pa.array(out_n, pa.int64()), "docs": pa.array(out_docs, pa.int64())})


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """(key, rid, class_id, n_links, n_copies, first): one row per document.

    ``n_links`` counts the other documents of similarity 0.8 or more, copies included; ``n_copies`` those of them with the same set. ``first``
    is the rid of the class's least (key, rid).
    """
    signed = written(_signed(docs, key, text), "signed")
    sets = written(signed.where("s is not null").groupBy("s").agg(F.count("*").alias("n"), F.min("sig").alias("sig"), F.min("size").alias("size"), F.min("rid").alias("any_rid"), F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("id"), "rid")).alias("least")), "sets")
    found = written(candidates(sets, recall).distinct(), "candidates")
    members = connected_components(found).withColumnRenamed("node", "s")
    forget(found)
    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    needed = written(members.join(sizes, "component").join(sets.select("s", "any_rid", "n", "sig", "size"), "s").select("s", "component", "m", "n", "sig", "size", F.col("any_rid").alias("rid")), "needed")
    many = needed.where(F.col("m") > BLOCK)
    chained = many.limit(1).count() > 0
    placed = needed.where(F.col("m") <= BLOCK).select(F.xxhash64("component").alias("key"), "s", F.lit(0).alias("own"), F.lit(0).alias("other"))
    if chained:
        pairs = _in_blocks(many, "component", "m", BLOCK).select("key", "s", "own", "other", "sig", "size")
        placed = written(placed.union(grouped_pass(pairs, "key", [], _meeting, "key long, s long, own int, other int")), "placed")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array([shingles(t, known).tobytes() for t in _texts(b.column(2))], pa.binary())], ["s", "n", "sh"])

    texts = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.col(text).cast("string").alias("_t")).join(small_or_shuffled(needed.select("rid", "s", "n")), "rid")
    bodies = arrow_pass(texts.select("s", "n", "_t"), again, "s long, n long, sh binary")
    meant = bodies.join(small_or_shuffled(placed), "s").select("key", "s", "own", "other", "n", "sh")
    linked = written(grouped_pass(meant, "key", [], _linked, "s long, root long, sets long, docs long"), "linked")
    links = linked.groupBy("s").agg(F.sum("docs").alias("docs"), F.min("root").alias("root"))
    if chained:
        whole = connected_components(linked.select(F.col("s").alias("src"), F.col("root").alias("dst")))
        links = links.join(whole.withColumnRenamed("node", "s"), "s", "left").withColumn("root", F.coalesce("component", "s")).drop("component")
    named = sets.select("s", "n", "least").join(links, "s", "left").withColumn("root", F.coalesce("root", "s")).withColumn("n_links", (F.coalesce("docs", F.lit(0)) + F.col("n") - 1).cast("long"))
    named = written(named.drop("docs"), "named")
    least = named.groupBy("root").agg(F.min("least").alias("c"))
    final = written(named.join(least, "root").select("s", "n", "n_links", F.col("c.id").alias("class_id"), F.col("c.rid").alias("first")), "classes")
    forget(linked, needed, named, sets, *([placed] if chained else []))
    out = join_on_hot_key(signed.select(key, "rid", "s"), final.withColumn("n_copies", F.col("n") - 1), "s", "n", ["n_links", "n_copies", "class_id", "first"], F.col("rid"))
    alone = F.col("s").isNull()
    none = F.lit(0)
    return out.select(key, "rid", F.when(alone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", none).cast("long").alias("n_links"), F.coalesce("n_copies", none).cast("long").alias("n_copies"), F.when(alone, F.col("rid")).otherwise(F.col("first")).alias("first"))


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text", recall: float = RECALL) -> DataFrame:
    """One row of each class, that of least key; rows without words all stay. Columns stay as they are."""
    each = written(classes(docs.select(key, text), key, text, recall), "membership")
    rows = docs.select(F.xxhash64(F.col(key), F.col(text)).alias("rid"), F.struct("*").alias("row"))
    gone = written(each.where("rid <> first").select("rid").distinct(), "gone")
    rows = rows.join(small_or_shuffled(gone), "rid", "left_anti")
    twice = written(each.where((F.col("rid") == F.col("first")) & (F.col("n_copies") > 0)).groupBy("rid").agg(F.count("*").alias("c")).where("c > 1").select("rid"), "twice")
    if twice.limit(1).count():  # equal rows: texts move only for these
        rows = rows.join(small_or_shuffled(twice), "rid", "left_anti").unionByName(rows.join(small_or_shuffled(twice), "rid", "left_semi").dropDuplicates(["rid"]))
    return rows.select("row.*")


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")
