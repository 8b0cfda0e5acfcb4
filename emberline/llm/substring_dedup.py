"""Substring deduplication by recompression.

A window is ``WINDOW`` words in a row of one document. Every word goes that a window covers whose word sequence also starts anywhere
else. Recompression names runs of one symbol and pairs of a left and a right symbol, round after round. A name is the hash of what it
stands for and the sides are a hash of the symbol, so names are global without a dictionary and rounds need no exchange: equal substrings
get equal symbols in their interior, in whatever task. For each symbol the words on which its existence depends are tracked: a window that
holds all of them has the symbol, at the same place, wherever it starts.

1. The symbols of the last round are counted over all documents; each document learns which of its symbols are shared. A symbol that stands
   nowhere else rules out all windows that hold the words it depends on.
2. What the shared symbols leave is named: a window's name is made of its interior symbols and their places in it, and beside it stands a
   second hash, of its 35 words themselves, which verifies what the symbols reveal. Both are made of 64-bit hashes of words, so that two words of
   one hash would count as equal; both together are counted over all documents.
3. Documents learn their repeated windows and drop the words that these cover.

Counting works on packed arrays: each task sends a key once, and tells its own documents itself what it finds twice, so a passage that
stands in a third of all rows reaches a counting task once per sending task. Shuffle partitions follow the measured bytes of the texts, and
shuffle files of finished steps are released before the next.

Defined cases: null and empty texts have no words; texts shorter than a window lose nothing; texts are taken whole, however long; equal rows
lose all words if they have a window; ties do not arise; an empty table gives no rows; extra columns, whatever their names, are ignored by
both functions.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.arrow import arrow_pass
from emberline.llm.ngram_join import WordHashes, _mix
from emberline.operators.skew import grouped_pass
from emberline.session import forget, table, written

WINDOW, ROUNDS = 35, 4
#: Words that a symbol stands for at least if it is to rule out windows.
LEAST = 2
#: Documents per group in which texts meet what was found about them, and words of a task's piece.
GROUP_DOCS, PIECE_WORDS = 2000, 1 << 20
#: Bytes of texts whose findings one shuffle partition takes.
PARTITION_BYTES = 12 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xCA5A826395121157)
_FOUND = "bucket long, kind int, body binary"


def parse(words: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(symbol, document, place, first, past, size): the last round's symbols, the word at which each begins, the words [first, past) that
    decide it, and how many it stands for."""
    at = np.arange(len(words))
    sym, st, en, lo, hi = words, at, at + 1, at, at + 1
    with np.errstate(over="ignore"):
        for r in range(rounds):
            salt = np.uint64(2 * r + 1) * _BASE
            # runs
            g = np.flatnonzero(np.concatenate([[True], (sym[1:] != sym[:-1]) | (doc[1:] != doc[:-1])])) if len(sym) else at
            last = np.append(g[1:], len(sym)) - 1
            k = last - g + 1
            s = np.where(k > 1, _mix(sym[g] * _A + k.astype(np.uint64) * _B + salt), sym[g])
            # a run ends where the symbols beside it differ: it depends on its own and on these two, with all that they depend on. At the edge of a document
            # it depends on a word that is not there, so no window has it, and what the next document adds to that does not matter
            st, en, doc = st[g], en[last], doc[g]
            run_lo, run_hi = np.minimum(np.minimum.reduceat(lo, g) if len(g) else lo, st - 1), np.maximum(np.maximum.reduceat(hi, g) if len(g) else hi, en + 1)
            for out, was, join in ((run_lo, lo, np.minimum), (run_hi, hi, np.maximum)):
                join(out[1:], was[g[1:] - 1], out=out[1:])
                join(out[:-1], was[g[1:]], out=out[:-1])
            lo, hi = run_lo, run_hi
            # pairs of a left and a right symbol
            right = (_mix(s ^ (salt + _A)) >> np.uint64(40)) & np.uint64(1) == 1
            first = np.zeros(len(s), bool)
            first[:-1] = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1])
            second = np.concatenate([[False], first[:-1]]) if len(s) else first
            f = np.flatnonzero(first)
            lo2, hi2, en2 = lo.copy(), hi.copy(), en.copy()
            alone = ~first & ~second
            # a left symbol is alone for what follows, a right one for what stands before
            left_alone, right_alone = np.flatnonzero(alone[:-1] & ~right[:-1]), np.flatnonzero(alone[1:] & right[1:]) + 1
            for own, other in ((left_alone, left_alone + 1), (right_alone, right_alone - 1)):
                lo2[own], hi2[own] = np.minimum(lo[own], lo[other]), np.maximum(hi[own], hi[other])
            new = s.copy()
            new[f] = _mix(s[f] * _A + s[f + 1] * _B + salt)
            lo2[f], hi2[f], en2[f] = np.minimum(lo[f], lo[f + 1]), np.maximum(hi[f], hi[f + 1]), en[f + 1]
            keep = ~second
            sym, st, en, lo, hi, doc = new[keep], st[keep], en2[keep], lo2[keep], hi2[keep], doc[keep]
    return sym, doc, st, lo, hi, en - st


def _pieces(rids: np.ndarray, texts: list[bytes | None], known: WordHashes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rids, word hashes, first word of each document and the end) of documents with a window, about ``PIECE_WORDS`` at a time."""
    got, ids, n = [], [], 0
    for rid, t in zip(rids, texts, strict=True):
        w = t.split() if t else []
        if len(w) >= WINDOW:
            got.append(np.fromiter([known[x] for x in w], np.uint64, len(w)))
            ids.append(rid)
            n += len(w)
        if n >= PIECE_WORDS:
            yield np.array(ids), np.concatenate(got), np.cumsum([0, *map(len, got)])
            got, ids, n = [], [], 0
    if got:
        yield np.array(ids), np.concatenate(got), np.cumsum([0, *map(len, got)])


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join([np.array([len(a) for a in arrays], np.int64).tobytes(), *[a.tobytes() for a in arrays]])


def _unpack(body: bytes, *kinds) -> list[np.ndarray]:
    sizes = np.frombuffer(body, np.int64, len(kinds))
    out, at = [], 8 * len(kinds)
    for n, kind in zip(sizes, kinds, strict=True):
        out.append(np.frombuffer(body, kind, n, at))
        at += int(n) * np.dtype(kind).itemsize
    return out


def _by_document(rids: np.ndarray, doc: np.ndarray, at: np.ndarray) -> bytes:
    """Positions per document, packed: documents, how many each, steps from one to the next. ``doc`` is ascending."""
    which, count = np.unique(doc, return_counts=True)
    step = np.diff(at, prepend=0)
    step[np.cumsum(count) - count] = at[np.cumsum(count) - count]
    return _pack(rids[which], count.astype(np.uint32), step.astype(np.int32))


def _positions(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rids, count, step = _unpack(body, np.int64, np.uint32, np.int32)
    at = np.cumsum(step.astype(np.int64))
    first = np.cumsum(count) - count
    base = np.repeat(at[first] - step[first], count) if len(count) else at
    return rids, count, at - base


def _stretches(x: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of each stretch of equal values."""
    if len(x):
        cuts = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]]))
        yield from zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)


def _told(rids: np.ndarray, doc: np.ndarray, at: np.ndarray, groups: int) -> Iterator[tuple[int, bytes]]:
    """(group of documents, packed positions)."""
    home = rids[doc] % groups
    order = np.lexsort((at, doc, home))
    home, doc, at = home[order], doc[order], at[order]
    for a, b in _stretches(home):
        yield int(home[a]), _by_document(rids, doc[a:b], at[a:b])


def _equal(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that puts equal keys (rows of one or two numbers) together, and where in it a new key begins."""
    order = np.argsort(keys[:, 0], kind="stable") if keys.shape[1] == 1 else np.lexsort((keys[:, 1], keys[:, 0]))
    new = np.ones(len(keys), bool)
    new[1:] = (keys[order[1:]] != keys[order[:-1]]).any(1)
    return order, new


def _sent(keys: np.ndarray, rids: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int, groups: int) -> Iterator[tuple[int, int, bytes]]:
    """What a task sends: kind 1: each of its keys once (document -1 if it has the key twice); kind 0: what is settled here."""
    if not len(keys):
        return
    order, new = _equal(keys)
    first = np.flatnonzero(new)
    several = np.diff(np.append(first, len(keys))) > 1
    twice = np.zeros(len(keys), bool)
    twice[order] = several[np.cumsum(new) - 1]
    for home, body in _told(rids, doc[twice], at[twice], groups):
        yield home % buckets, 0, np.int64(home).tobytes() + body
    many = keys[order[first[several]]]
    key = np.concatenate([keys[~twice], many])
    of, pos = np.concatenate([doc[~twice], np.full(len(many), -1)]), np.concatenate([at[~twice], np.zeros(len(many), at.dtype)])
    home = (key[:, 0] >> np.uint64(20)) % np.uint64(buckets)
    order = np.lexsort((pos, of, home))
    key, of, pos, home = key[order], of[order], pos[order], home[order]
    own = np.append(rids, 0)  # the last stands for -1
    for a, b in _stretches(home):
        of2 = np.where(of[a:b] < 0, len(rids), of[a:b])
        order2 = np.argsort(of2, kind="stable")
        yield int(home[a]), 1, _pack(key[a:b][order2]) + _by_document(own, of2[order2], pos[a:b][order2])


def _rows(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([x[0] for x in found], pa.int64()), "kind": pa.array([x[1] for x in found], pa.int32()), "body": pa.array([x[2] for x in found], pa.binary())})


def _batched(rows: Iterator[tuple[int, int, bytes]], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[2])
        if size > most:
            yield _rows(held)
            held, size = [], 0
    if held:
        yield _rows(held)


def _counted(sent: DataFrame, groups: int, width: int, partitions: int) -> DataFrame:
    """(bucket: group of documents, kind 0, body): positions whose key, of ``width`` numbers, stands anywhere else."""

    def count(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        kinds, bodies = t.column("kind").to_numpy(), t.column("body")

        def told() -> Iterator[tuple[int, int, bytes]]:
            for lo, hi in zip(starts, np.append(starts[1:], len(kinds)), strict=True):
                keys, rid, pos = [], [], []
                for i in range(lo, hi):
                    body = bodies[int(i)].as_py()
                    if kinds[i] == 0:
                        yield int(np.frombuffer(body, np.int64, 1)[0]), 0, body[8:]
                        continue
                    n = int(np.frombuffer(body, np.int64, 1)[0])
                    keys.append(np.frombuffer(body, np.uint64, n * width, 8).reshape(n, width))
                    r, c, at = _positions(body[8 + 8 * width * n :])
                    rid.append(np.repeat(r, c))
                    pos.append(at)
                    many = np.repeat(r == 0, c)
                    if many.any():  # keys that their sender has twice count double
                        keys.append(keys[-1][many])
                        rid.append(np.zeros(int(many.sum()), np.int64))
                        pos.append(at[many])
                if not keys:
                    continue
                key, r, p = np.concatenate(keys), np.concatenate(rid), np.concatenate(pos)
                order, new = _equal(key)
                shared = np.zeros(len(key), bool)
                shared[order] = ~new | ~np.append(new[1:], True)
                shared &= r != 0
                ids, doc = np.unique(r[shared], return_inverse=True)
                for home, body in _told(ids, doc, p[shared], groups):
                    yield home, 0, body

        yield from _batched(told())

    return grouped_pass(sent, "bucket", ["kind"], count, _FOUND, partitions)


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """rid is not 0 nor negative, so that 0 can stand for no document."""
    return docs.select(F.col(key).alias("k"), (F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 1) + F.when(F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 1) == 0, 1).otherwise(0)).alias("rid"), F.col(text).cast("string").cast("binary").alias("t"))


def _shared_symbols(rows: DataFrame, buckets: int, groups: int, partitions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            for rids, words, first in _pieces(b.column(0).to_numpy(), b.column(1).to_pylist(), known):
                sym, doc, _, _, _, size = parse(words, np.repeat(np.arange(len(rids)), np.diff(first)))
                number = np.arange(len(sym)) - np.searchsorted(doc, doc)
                told = (size >= LEAST) & (size <= WINDOW)  # by the symbol alone, so that all its places count alike
                yield from _batched(_sent(sym[told][:, None], rids, doc[told], number[told], buckets, groups))

    return _counted(arrow_pass(rows.select("rid", "t"), run, _FOUND), groups, 1, partitions)


def _packed(rows: DataFrame, groups: int) -> DataFrame:
    """(bucket: group of documents, kind 1, body): the rows, whose rid tells the group, as compressed Arrow streams of a group each."""
    def stream(b: pa.RecordBatch) -> bytes:
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
            w.write_batch(b)
        return out.getvalue().to_pybytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            home = b.column(b.schema.get_field_index("rid")).to_numpy() % groups
            order = np.argsort(home, kind="stable")
            home = home[order]
            yield from _batched((int(home[x]), 1, stream(b.take(pa.array(order[x:y])))) for x, y in _stretches(home))

    return arrow_pass(rows, run, _FOUND)


def _learn(t: pa.Table, lo: int, hi: int) -> tuple[dict[int, np.ndarray], pa.Table]:
    """What was found about the documents of a group, and their rows; findings come first."""
    kinds, bodies = t.column("kind").to_numpy(), t.column("body")
    known: dict[int, list[np.ndarray]] = {}
    streams = []
    for i in range(lo, hi):
        body = bodies[int(i)].as_py()
        if kinds[i] == 1:
            streams.append(pa.ipc.open_stream(body).read_all())
            continue
        rids, count, at = _positions(body)
        for r, part in zip(rids.tolist(), np.split(at, np.cumsum(count)[:-1]), strict=True):
            known.setdefault(r, []).append(part)
    return {r: np.concatenate(p) for r, p in known.items()}, pa.concat_tables(streams).combine_chunks() if streams else None


def _hashed(words: np.ndarray, start: np.ndarray, power: np.ndarray, back: np.ndarray) -> np.ndarray:
    """A hash of the words of each window, whatever stands before it."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * power[:-1])])
    return _mix((total[start + WINDOW] - total[start]) * back[start])


def _named(sym: np.ndarray, at: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, start: np.ndarray, power: np.ndarray, back: np.ndarray) -> np.ndarray:
    """The name of each window: its interior symbols, which the words [a, b) decide, with their places in it."""
    inner = b - a <= WINDOW
    value = _mix(sym[inner] ^ _A) * power[at[inner]]
    edge = np.zeros(len(power), np.uint64)
    np.add.at(edge, np.maximum(b[inner] - WINDOW, first[inner]), value)
    np.subtract.at(edge, a[inner] + 1, value)
    return _mix(np.cumsum(edge)[start] * back[start] + _B)


def _repeated_windows(rows: DataFrame, found: DataFrame, buckets: int, groups: int, partitions: int) -> DataFrame:
    def verify(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        words_of = WordHashes()
        for lo, hi in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            shared, own = _learn(t, lo, hi)
            for rids, words, first in _pieces(own.column("rid").to_numpy(), own.column("t").to_pylist(), words_of):
                sym, doc, at, a, b, size = parse(words, np.repeat(np.arange(len(rids)), np.diff(first)))
                begin = np.searchsorted(doc, np.arange(len(rids)))
                single = (b - a <= WINDOW) & (size >= LEAST) & (size <= WINDOW)
                for d, rid in enumerate(rids.tolist()):
                    if (s := shared.get(rid)) is not None:
                        single[begin[d] + s] = False
                # windows [b - WINDOW, a] hold all words of a symbol that stands nowhere else
                ruled = np.zeros(len(words) + 1, np.int64)
                np.add.at(ruled, np.maximum(b[single] - WINDOW, first[doc[single]]), 1)
                np.add.at(ruled, a[single] + 1, -1)
                inside = np.arange(len(words)) + WINDOW <= np.repeat(first[1:], np.diff(first))
                start = np.flatnonzero((np.cumsum(ruled[:-1]) == 0) & inside)
                if not len(start):
                    continue
                with np.errstate(over="ignore"):
                    power = np.full(len(words) + 1, _BASE)
                    power[0] = 1
                    power = np.multiply.accumulate(power)
                    back = np.full(len(words) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
                    back[0] = 1
                    back = np.multiply.accumulate(back)
                    keys = np.column_stack([_named(sym, at, a, b, first[doc], start, power, back), _hashed(words, start, power, back)])
                of = np.searchsorted(first, start, side="right") - 1
                yield from _batched(_sent(keys, rids, of, start - first[of], buckets, groups))

    sent = grouped_pass(_packed(rows, groups).union(found), "bucket", ["kind"], verify, _FOUND, partitions)
    return _counted(sent, groups, 2, partitions)


def _release(spark: SparkSession) -> None:
    """Let Spark delete shuffle files that nothing can read any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _applied(docs: DataFrame, key: str, text: str, with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = _keyed(docs, key, text)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t").cast("long")), F.lit(0))).first()
    partitions = max(8, -(-size // PARTITION_BYTES))
    groups, buckets = max(8, n // GROUP_DOCS, 2 * partitions), max(48, n // 2500, 2 * partitions)
    symbols = written(_shared_symbols(rows, buckets, groups, partitions), "symbols")
    _release(spark)
    windows = written(_repeated_windows(rows.select("rid", "t"), symbols, buckets, groups, partitions), "windows")
    forget(symbols)
    _release(spark)
    kind = dict(docs.dtypes)[key]
    what = "kept binary" if with_text else "kept_sha256 string"

    def cut(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        for lo, hi in zip(starts, np.append(starts[1:], t.num_rows), strict=True):
            known, own = _learn(t, lo, hi)
            total, removed, kept = [], [], []
            for rid, body in zip(own.column("rid").to_pylist(), own.column("t").to_pylist(), strict=True):
                words = body.split() if body else []
                total.append(len(words))
                gone = 0
                if (at := known.get(rid)) is not None:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, at, 1)
                    np.add.at(edge, at + WINDOW, -1)
                    stay = np.cumsum(edge[:-1]) == 0
                    gone = len(words) - int(stay.sum())
                    words = [words[j] for j in np.flatnonzero(stay)]
                removed.append(gone)
                rest = b" ".join(words)
                kept.append((body if not gone else rest) if with_text else hashlib.sha256(rest).hexdigest())
            yield pa.RecordBatch.from_arrays([own.column("k").combine_chunks(), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary() if with_text else pa.string())], [key, "n_words", "n_removed", what.split()[0]])

    met = _packed(rows, groups).union(windows)
    return grouped_pass(met, "bucket", ["kind"], cut, f"`{key}` {kind}, n_words long, n_removed long, {what}", partitions)


def removals(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, n_removed, kept_sha256) for every row."""
    return _applied(docs, key, text, False)


def deduplicated(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, n_words, n_removed): texts without their repeats; a text that loses nothing stays as it is."""
    out = _applied(docs, key, text, True)
    return out.select(key, F.col("kept").cast("string").alias(text), "n_words", "n_removed")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removals(table(spark, sf_dir, "documents"))
