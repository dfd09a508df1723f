"""Document fingerprints by context-triggered piecewise hashing.

A hash rolls over windows of ``WINDOW`` bytes; where its lowest k bits are zero a
piece ends, so that equal passages are cut alike wherever they stand.  Each piece
gives one of 64 characters.  k is the largest at which a text has at least
``HALF`` cuts (``LEAST_K`` for short texts), and a fingerprint holds the
characters at k and at k + 1, up to ``FULL`` each, of which the last stands for
all the rest: of a text with more pieces than that, which happens where cuts
cluster, a change behind the last cut that counts shows in one character only.
Two fingerprints are compared at k's they share, by edit distance,
bit-parallel over all pairs of a batch.

Neighbours in order of doc_id come from a range partition: each task streams its
sorted rows, and only the first and last document of each part meet across parts
in a join on the part.

Defined results: a null text is an empty one, whose fingerprint has no
characters; rows without doc_id come last, rows that share one are in order of a
hash of their texts; a single document is its own neighbour; an empty table
gives none; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .store import mapped, ship, stash, trim

WINDOW, LEAST_K, HALF, FULL = 7, 2, 32, 64
_LETTERS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_ROLL = np.random.default_rng(5813).integers(1, 1 << 32, 256, dtype=np.uint32)
_ROLL[0] = 0
_PLAIN = np.arange(256, dtype=np.uint8)


def _levels(data: np.ndarray) -> np.ndarray:
    """Number of zero bits at the end of the hash of the window that ends at each byte (at most 31)."""
    value = _ROLL[data]
    total, part = value.copy(), value
    for _ in range(WINDOW - 1):
        part = np.concatenate([np.zeros(1, np.uint32), part[:-1]]) * np.uint32(0x01000193)
        total += part
    total ^= total >> np.uint32(15)
    total *= np.uint32(0x2C1B3C6D)
    total ^= total >> np.uint32(12)
    low = total & (~total + np.uint32(1))
    out = np.full(len(data), 31, np.int8)
    some = low > 0
    out[some] = np.log2(low[some].astype(np.float64)).astype(np.int8)
    return out


class Marks:
    """Fingerprints of a list of texts, as arrays."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join([b"\0" * (WINDOW - 1) + t for t in texts]), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size + WINDOW - 1)
        self.start = self.end - size
        n = len(texts)
        value = _levels(self.data) if len(self.data) else np.zeros(0, np.int8)
        at = np.flatnonzero(value >= LEAST_K)
        owner = np.searchsorted(self.end, at, "right")
        inside = at >= self.start[owner] if len(at) else np.zeros(0, bool)
        at, owner = at[inside], owner[inside]
        level = value[at]
        counts = np.bincount(owner * 32 + level, minlength=32 * n).reshape(n, 32)[:, ::-1].cumsum(axis=1)[:, ::-1]
        self.k = np.maximum(LEAST_K, 31 - np.argmax(counts[:, ::-1] >= HALF, axis=1))
        self.k[~(counts >= HALF).any(axis=1)] = LEAST_K
        self.rows, self.sizes = zip(*(self._signature(at, owner, level, self.k + up) for up in (0, 1)), strict=True)

    def _signature(self, at: np.ndarray, owner: np.ndarray, level: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(k)
        use = level >= k[owner]
        cut, who = at[use] + 1, owner[use]
        place = np.arange(len(cut)) - np.searchsorted(who, who)
        early = place < FULL - 1  # the last character stands for the rest
        cut, who, place = cut[early], who[early], place[early]
        starts = np.where(place == 0, self.start[who], np.concatenate([[0], cut[:-1]])) if len(cut) else cut
        count = np.bincount(who, minlength=n)
        last = self.start.copy()
        if len(cut):
            has = count > 0
            last[has] = cut[np.cumsum(count)[has] - 1]
        rest = np.flatnonzero(last < self.end)
        starts, ends = np.concatenate([starts, last[rest]]), np.concatenate([cut, self.end[rest]])
        who, place = np.concatenate([who, rest]), np.concatenate([place, count[rest]])
        order = np.argsort(ends, kind="stable")
        letters = _LETTERS[(bs.hashes(self.data, starts[order], ends[order], _PLAIN) >> np.uint64(58)).astype(np.int64)]
        out = np.zeros((n, FULL), np.uint8)
        out[who[order], place[order]] = letters
        size = count.copy()
        size[rest] += 1
        return out, size

    def strings(self) -> list[str]:
        """Block size, characters at it and at twice it."""
        first, second = ([r[:s].tobytes().decode() for r, s in zip(rows, sizes.tolist(), strict=True)] for rows, sizes in zip(self.rows, self.sizes, strict=True))
        return [f"{1 << k}:{a}:{b}" for k, a, b in zip(self.k.tolist(), first, second, strict=True)]

    def pick(self, at: np.ndarray) -> Marks:
        out = object.__new__(Marks)
        out.k, out.rows, out.sizes = self.k[at], tuple(r[at] for r in self.rows), tuple(s[at] for s in self.sizes)
        return out


def distances(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Edit distance of each pair of strings of at most 64 characters, 64 cells of a column at a time."""
    one = np.uint64(1)
    weights = one << np.arange(FULL, dtype=np.uint64)
    valid = np.arange(FULL) < na[:, None]
    plus, minus = np.full(len(a), ~np.uint64(0)), np.zeros(len(a), np.uint64)
    score, top = na.astype(np.int64).copy(), one << np.maximum(na - 1, 0).astype(np.uint64)
    for j in range(int(nb.max(initial=0))):
        live = j < nb
        equal = (((a == b[:, j, None]) & valid) * weights).sum(axis=1, dtype=np.uint64)
        xv = equal | minus
        xh = (((equal & plus) + plus) ^ plus) | equal
        ph, mh = minus | ~(xh | plus), plus & xh
        score += live * ((ph & top) > 0).astype(np.int64) - live * ((mh & top) > 0).astype(np.int64)
        ph, mh = (ph << one) | one, mh << one
        new_plus, new_minus = mh | ~(xv | ph), ph & xv
        plus, minus = np.where(live, new_plus, plus), np.where(live, new_minus, minus)
    return np.where(na == 0, nb, score)


def likeness(x: Marks, y: Marks) -> np.ndarray:
    """1 for equal fingerprints, 0 for those of no common block size, else 1 - distance / length of the longer."""
    out = np.zeros(len(x.k))
    for i, j in ((0, 0), (1, 1), (0, 1), (1, 0)):
        rows = np.flatnonzero(x.k + i == y.k + j)
        if len(rows):
            na, nb = x.sizes[i][rows], y.sizes[j][rows]
            d = distances(x.rows[i][rows], na, y.rows[j][rows], nb)
            out[rows] = np.maximum(out[rows], 1 - d / np.maximum(1, np.maximum(na, nb)))
    return out


def _compare(ids: pa.Array, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result rows for texts and the texts that follow them."""
    half = [len(t) // 2 for t in texts]
    edited = [(t[: len(t) - h] + f[:h]).encode() for t, f, h in zip(texts, following, half, strict=True)]
    n = len(texts)
    chain = n > 1 and all(a is b for a, b in zip(texts[1:], following[:-1], strict=True))
    source = [t.encode() for t in texts] + ([following[-1].encode()] if chain else [f.encode() for f in following])
    marks = Marks(source + edited)
    own, other = marks.pick(np.arange(n)), marks.pick(np.arange(len(source), len(source) + n))
    after = marks.pick(np.arange(1, n + 1) if chain else np.arange(n, 2 * n))
    digests = [hashlib.sha256(e).hexdigest() for e in edited]
    return pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, texts)), pa.int64()), pa.array(digests, pa.string()), pa.array(own.strings(), pa.string()), pa.array(other.strings(), pa.string()), pa.array(likeness(own, other)), pa.array(likeness(own, after))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def fingerprints(texts: DataFrame) -> DataFrame:
    """The rows of ``texts`` (doc_id, text) as (doc_id, fingerprint)."""
    kind = texts.schema["doc_id"].dataType.simpleString()

    def each(batch):
        for i, j in bs.slices(bs.column(batch.column(1))[1]):
            part = [(t or "").encode() for t in batch.column(1).slice(i, j - i).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(Marks(part).strings(), pa.string())], ["doc_id", "fingerprint"])

    return mapped(texts.select("doc_id", "text"), each, f"doc_id {kind}, fingerprint string")


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of each row.

    The edited text has its last half replaced by the start of the document with the next smaller doc_id.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    keys = [F.col("doc_id").desc_nulls_last(), F.xxhash64("text")]
    ordered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    ship(docs.sparkSession)

    def run(batches):
        part, held_id, held, whole = TaskContext.get().partitionId(), None, None, None

        def edge(which, ids, text):
            nothing = [pa.nulls(1, f.type) for f in list(whole)[1:]]
            return pa.RecordBatch.from_arrays([ids, *nothing, pa.array([which], pa.string()), pa.array([part], pa.int32()), pa.array([text], pa.string())], [*whole.names, "edge", "part", "text"])

        for batch in batches:
            for i, j in bs.slices(bs.column(batch.column(1))[1]):
                ids, texts = batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i).to_pylist()
                first = held is None
                if not first:
                    ids, texts = pa.concat_arrays([held_id, ids]), [held, *texts]
                done = _compare(ids[:-1], texts[:-1], texts[1:])
                whole = done.schema
                if first:
                    yield edge("head", ids[:1], texts[0])
                held_id, held = ids[-1:], texts[-1]
                n = done.num_rows
                yield pa.RecordBatch.from_arrays([*done.columns, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.string())], [*whole.names, "edge", "part", "text"])
        if held is not None:
            yield edge("tail", held_id, held)
        trim()

    rows = stash(ordered.mapInArrow(run, f"{result}, edge string, part int, text string"), "neighbours")
    heads = rows.filter("edge = 'head'")
    order = Window.orderBy("part")
    parts = heads.select("part").withColumn("next", F.lead("part").over(order)).withColumn("next", F.coalesce("next", F.min("part").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    tails = rows.filter("edge = 'tail'").join(parts, "part").join(heads.select(F.col("part").alias("next"), F.col("text").alias("following")), "next").select("doc_id", "text", "following")

    def each(batch):
        for r in range(batch.num_rows):
            yield _compare(batch.column(0).slice(r, 1), batch.column(1).slice(r, 1).to_pylist(), batch.column(2).slice(r, 1).to_pylist())

    inner = rows.filter("edge is null").drop("edge", "part", "text")
    return inner.union(mapped(tails, each, result))
