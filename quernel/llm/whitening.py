"""Whitening of embeddings from a compensated covariance.

Entries c become whole numbers x = floor(256 c).  The fit takes each distinct vector once.

1. Distinct vectors, packed in as few bytes as they need, go through one aggregation, so that a
   vector that a third of all rows repeat is one row of each task before anything moves.
2. Sums of x are exact whole numbers; the mean is a double-double.
3. Each task centres its vectors and adds up outer products in double-double.  A block of at most
   ``ROWS`` vectors is split without error into slices of ``SLICE`` bits; products of the
   leading slices have no rounding (2 * SLICE bits and the bits of ROWS fit a double), the rest is
   too small for its rounding to count.  Blocks are added by error-free sums.
4. High and low parts of the tasks merge in a tree of ``FAN`` until few enough reach the driver.
5. There the matrix is made tridiagonal and solved by divide and conquer (LAPACK's dsyevd, which
   ``numpy.linalg.eigh`` calls).  Its leading vectors are corrected with residuals in
   double-double until they are right to the last bits of a double.
6. One more scan of the distinct vectors measures how far the whitened covariance is from the identity.

What the driver gets grows with the square of the dimension, at most ``MOST_DIM``, and not with rows.

Defined results: rows whose vector is null or holds null or non-finite entries are dropped; so are
vectors of another length than most distinct vectors have (of equal numbers the longest; empty ones never count);
x stops at the bounds of a long; a deviation beyond a long is null; components whose variance is
nothing but rounding have null coordinates; an empty table gives none; rows that repeat stay;
columns named like results are replaced, all others kept.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .store import mapped, ship, stash, trim

SCALE, MOST_DIM, COMPONENTS = 256, 2048, 4
SLICE, ROWS, FAN, DRIVER_BYTES = 21, 1 << 11, 32, 64 << 20
_SPLIT = float((1 << 27) + 1)


def two_sum(a, b):
    """a + b and its rounding error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def two_product(a, b):
    """a * b and its rounding error, exactly."""
    p = a * b
    c = _SPLIT * a
    ah = c - (c - a)
    c = _SPLIT * b
    bh = c - (c - b)
    al, bl = a - ah, b - bh
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def added(a: tuple, b: tuple) -> tuple:
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    return two_sum(s, e + (a[1] + b[1]))


def summed(a: tuple) -> tuple:
    """Sum of double-doubles along the last axis, in a tree."""
    hi, lo = a
    while hi.shape[-1] > 1:
        if hi.shape[-1] & 1:
            pad = np.zeros((*hi.shape[:-1], 1))
            hi, lo = np.concatenate([hi, pad], -1), np.concatenate([lo, pad], -1)
        hi, lo = added((hi[..., 0::2], lo[..., 0::2]), (hi[..., 1::2], lo[..., 1::2]))
    return hi[..., 0], lo[..., 0]


def product(a: tuple, b: tuple) -> tuple:
    """Product of two double-doubles."""
    p, e = two_product(a[0], b[0])
    return two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def ratio(a: tuple, b: tuple) -> tuple:
    """Quotient of two double-doubles."""
    q = a[0] / b[0]
    p = product((q, np.zeros_like(q)), b)
    rest = added(a, (-p[0], -p[1]))
    return two_sum(q, rest[0] / b[0])


def sliced(z: np.ndarray, low: np.ndarray | None = None) -> list[np.ndarray]:
    """z in parts of SLICE bits below each column's largest power of two, and what is left (with ``low``); their sum is exact but for the last."""
    top = np.abs(z).max(axis=0, initial=0)
    unit = np.ldexp(1.0, np.frexp(np.where(top > 0, top, 1))[1] - SLICE)
    out = []
    for _ in range(2):
        part = np.rint(z / unit) * unit
        out.append(part)
        z = z - part
        unit = np.ldexp(unit, -SLICE)
    return [*out, z if low is None else z + low]


class Products:
    """Sums and sums of outer products, in double-double."""

    def __init__(self, d: int):
        self.sums, self.outer = (np.zeros(d), np.zeros(d)), (np.zeros((d, d)), np.zeros((d, d)))

    def add(self, z: np.ndarray, low: np.ndarray | None = None) -> None:
        for a in range(0, len(z), ROWS):
            h, m, r = sliced(z[a : a + ROWS], None if low is None else low[a : a + ROWS])
            for part in (h, m, r):
                self.sums = added(self.sums, (part.sum(axis=0), np.zeros(part.shape[1])))
            hm, hr, mr = h.T @ m, h.T @ r, m.T @ r
            for part in (h.T @ h, hm, hm.T, m.T @ m, hr, hr.T, mr, mr.T, r.T @ r):
                self.outer = added(self.outer, (part, np.zeros_like(part)))

    def merge(self, other: Products) -> None:
        self.sums, self.outer = added(self.sums, other.sums), added(self.outer, other.outer)

    def packed(self) -> bytes:
        at = np.triu_indices(len(self.sums[0]))
        return np.concatenate([*self.sums, self.outer[0][at], self.outer[1][at]]).tobytes()

    @staticmethod
    def unpacked(data: bytes, d: int) -> Products:
        out, flat, at = Products(d), np.frombuffer(data), np.triu_indices(d)
        out.sums = flat[:d].copy(), flat[d : 2 * d].copy()
        for k, part in enumerate(np.split(flat[2 * d :], 2)):
            out.outer[k][at] = part
            out.outer[k].T[at] = part
        return out


def grid(array: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which rows hold a vector, the first entry and the length of each, of a list column."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    offs = array.offsets.to_numpy().astype(np.int64)
    bad = np.zeros(len(array), bool) if not array.null_count else array.is_null().to_numpy(zero_copy_only=False)
    values = array.values
    c = values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0)
    wrong = np.concatenate([[0], np.cumsum(~np.isfinite(c))])  # nulls come as NaN
    return ~bad & (wrong[offs[1:]] == wrong[offs[:-1]]), offs[:-1], np.diff(offs)


def whole(array: pa.Array, rows: np.ndarray, first: np.ndarray, d: int) -> np.ndarray:
    """x of the given rows, which have d entries each."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    c = array.values.cast(pa.float64()).to_numpy(zero_copy_only=False) if len(array.values) else np.zeros(0)
    with np.errstate(over="ignore"):
        f = np.floor(SCALE * c[first[rows][:, None] + np.arange(d)])
    most = 2.0**63
    out = np.where(np.abs(f) < most, f, 0).astype(np.int64)
    return np.where(f >= most, np.int64((1 << 63) - 1), np.where(f <= -most, np.int64(-(1 << 63)), out))


def pack(x: np.ndarray) -> list[bytes]:
    """Each row in the least number of bytes an entry; equal rows, and only these, give equal bytes."""
    most = np.maximum(x.max(axis=1, initial=0), -(x.min(axis=1, initial=0) + 1))
    width = np.searchsorted(np.array([127, 32767, 2147483647]), most)
    return [b"%d" % w + x[r].astype(f"<i{1 << w}").tobytes() for r, w in enumerate(width.tolist())]


def unpack(column: pa.Array, d: int) -> np.ndarray:
    out = np.empty((len(column), d), np.int64)
    for r, v in enumerate(column):
        data = v.as_buffer()
        out[r] = np.frombuffer(data, f"<i{1 << (data[0] - 0x30)}", d, 1)
    return out


def distinct(rows: DataFrame, vector: str) -> DataFrame:
    """(d, v): each distinct vector of at least one entry, packed."""

    def each(batch):
        array = batch.column(0)
        good, first, size = grid(array)
        for d in np.unique(size[good & (size > 0)]).tolist():
            if d > MOST_DIM:
                raise ValueError(f"vectors of over {MOST_DIM} entries")
            at = np.flatnonzero(good & (size == d))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(pack(whole(array, at, first, d)), pa.binary())], ["d", "v"])

    return stash(mapped(rows.select(vector), each, "d int, v binary").distinct(), "vectors")


def gathered(vectors: DataFrame, d: int, fill) -> Products:
    """Products of all vectors; ``fill(products, x)`` adds a block."""
    ship(vectors.sparkSession)

    def start(batches):
        out = Products(d)
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                fill(out, unpack(batch.column(0).slice(a, ROWS), batch_dim(batch)))
        yield pa.RecordBatch.from_arrays([pa.array([out.packed()], pa.binary())], ["p"])
        trim()

    def merge(batches):
        out = None
        for batch in batches:
            for v in batch.column(0):
                one = Products.unpacked(v.as_py(), d)
                out = one if out is None else out
                if out is not one:
                    out.merge(one)
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.packed()], pa.binary())], ["p"])
        trim()

    parts = stash(vectors.select("v", "d").mapInArrow(start, "p binary"), "products")
    few, n = max(1, min(FAN, DRIVER_BYTES // (16 * d * d))), parts.count()
    while n > few:
        n = max(-(-n // FAN), 1)
        parts = stash(parts.repartition(n).mapInArrow(merge, "p binary"), "products")
    total = Products(d)
    for v in parts.toArrow()["p"]:
        total.merge(Products.unpacked(v.as_py(), d))
    return total


def batch_dim(batch: pa.RecordBatch) -> int:
    return batch.column(1)[0].as_py()


def corrected(v: tuple, values: np.ndarray, vectors: np.ndarray, k: int, times: int = 4) -> tuple[tuple, float]:
    """Eigenvector k as a unit double-double and its value, from residuals in double-double."""
    q, zero = (vectors[:, k].copy(), np.zeros(len(values))), np.zeros(len(values))
    gap = values[k] - values
    apart = np.abs(gap) > 1e-13 * np.abs(values).max(initial=0)
    for _ in range(times):
        image = summed(product(v, q))
        value = ratio(summed(product(q, image)), summed(product(q, q)))
        rest = added(image, tuple(-x for x in product(q, (np.broadcast_to(value[0], zero.shape), np.broadcast_to(value[1], zero.shape)))))
        share = np.where(apart, (vectors.T @ rest[0]) / np.where(apart, gap, 1), 0)
        q = added(q, (vectors @ share, zero))
        length = summed(product(q, q))
        half = 0.5 * ((length[0] - 1) + length[1])  # the length is 1 but for rounding
        q = added(q, (-half * q[0], zero))
    return q, float(value[0] + value[1])


@dataclass
class Whitening:
    """A fitted whitening."""

    d: int
    n: int
    sums: list[int]
    values: list[float] = field(default_factory=list)
    high: np.ndarray | None = None
    low: np.ndarray | None = None
    trace: float = 0.0
    identity_error: float | None = None

    def __post_init__(self):
        mean = [Fraction(s, self.n) for s in self.sums] if self.n else []
        self.mean = np.array([float(m) for m in mean])
        self.mean_low = np.array([float(m - Fraction(float(m))) for m in mean])

    @property
    def explained(self) -> list[float]:
        return [v / self.trace if self.trace else 0.0 for v in self.values]

    @property
    def sound(self) -> np.ndarray:
        """Components with more variance than rounding."""
        v = np.array(self.values)
        return v > self.d * 2.0**-52 * v.max(initial=0)

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        high = x.astype(np.float64)
        back = np.where(np.abs(high) < 2.0**63, high, 0).astype(np.int64)
        low = np.where(np.abs(high) < 2.0**63, (x - back).astype(np.float64), np.where(high > 0, -1.0, 0.0))
        z, e = two_sum(high, -self.mean)
        return two_sum(z, e + (low - self.mean_low))

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of x; columns without variance are NaN."""
        z, low = self.centred(x)
        h, m, r = sliced(z, low)
        qh, qm, qr = sliced(self.high, self.low)
        exact = two_sum(h @ qh, h @ qm + m @ qh)
        dot = exact[0] + (exact[1] + (m @ qm + h @ qr + r @ (qh + qm) + m @ qr))
        value = np.array(self.values)
        return np.where(self.sound, dot / np.sqrt(np.where(self.sound, value, 1)), np.nan)

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2, exactly; null beyond a long."""
        rough = ((self.n * x.astype(np.float64) - np.array([float(s) for s in self.sums])) ** 2).sum(axis=1)
        most = self.n * float(np.abs(x.astype(np.float64)).max(initial=0)) + max([0.0, *(abs(float(s)) for s in self.sums)])
        if self.d * most * most < 2.0**62:
            return pa.array(((self.n * x - np.array(self.sums, np.int64)) ** 2).sum(axis=1))
        out = []
        for row, about in zip(x.tolist(), rough.tolist(), strict=True):
            exact = sum((self.n * v - s) ** 2 for v, s in zip(row, self.sums, strict=True)) if about < 2.0**64 else 1 << 63
            out.append(exact if exact < 1 << 63 else None)
        return pa.array(out, pa.int64())


def fit(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening:
    """The whitening of the distinct vectors of a table."""
    every = distinct(rows, vector)
    sizes = every.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not sizes:
        return Whitening(0, 0, [])
    d, n = sizes[0]["d"], sizes[0]["n"]
    vectors = every.filter(F.col("d") == d)

    def sums(batches):
        high, low, some = np.zeros(d, np.int64), np.zeros(d, np.int64), False
        for batch in batches:
            x, some = unpack(batch.column(0), d), True
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), pa.array(high), pa.array(low)], ["j", "high", "low"])
        trim()

    ship(rows.sparkSession)
    parts = vectors.select("v").mapInArrow(sums, "j int, high bigint, low bigint")
    wide = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = {r["j"]: (int(r["high"]) << 32) + int(r["low"]) for r in parts.groupBy("j").agg(*wide).collect()}
    model = Whitening(d, n, [found[j] for j in range(d)])

    total = gathered(vectors, d, lambda out, x: out.add(*model.centred(x)))
    count = (np.float64(n), np.float64(n - int(float(n))))
    # The centre is a rounded mean; what it lacks goes by sums of the centred entries.
    mean = ratio(total.sums, count)
    shift = product((mean[0][:, None], mean[1][:, None]), (mean[0][None, :], mean[1][None, :]))
    v = ratio(total.outer, count)
    v = added(v, (-shift[0], -shift[1]))
    top = float(np.ldexp(1.0, np.frexp(max(np.abs(v[0]).max(initial=0), np.finfo(float).tiny))[1]))
    v = v[0] / top, v[1] / top
    values, q = np.linalg.eigh(v[0])
    order = np.argsort(-values, kind="stable")
    values, q = values[order], q[:, order]
    pairs = [corrected(v, values, q, k) for k in range(min(components, d))]
    ranked = sorted(range(len(pairs)), key=lambda k: -pairs[k][1])
    model.values = [max(pairs[k][1], 0.0) * top for k in ranked]
    model.high, model.low = (np.stack([pairs[k][0][part] for k in ranked], axis=1) for part in (0, 1))
    model.trace = float(Fraction(0) + sum(Fraction(float(a)) + Fraction(float(b)) for a, b in zip(np.diag(v[0]), np.diag(v[1]), strict=True)) * Fraction(top))
    if model.sound.any():
        use = model.sound
        white = gathered(vectors, int(use.sum()), lambda out, x: out.add(model.coordinates(x)[:, use]))
        mean = ratio(white.sums, count)[0]
        cov = ratio(white.outer, count)[0] - mean[:, None] * mean[None, :]
        model.identity_error = float(np.abs(cov - np.eye(len(cov))).max())
    return model


def transform(rows: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Rows that have a vector, with ``whitened`` (an entry for each component) and ``deviation``."""
    kept = rows.select(*[c for c in rows.columns if c not in ("whitened", "deviation")])
    place = kept.columns.index(vector)
    schema = StructType([*kept.schema.fields, StructField("whitened", ArrayType(DoubleType())), StructField("deviation", LongType())])

    def each(batch):
        array = batch.column(place)
        good, first, size = grid(array)
        at = np.flatnonzero(good & (size == model.d))
        for a in range(0, len(at) if model.n else 0, ROWS):
            part = at[a : a + ROWS]
            x = whole(array, part, first, model.d)
            w = model.coordinates(x)
            flat = pa.array(w.ravel(), mask=np.isnan(w.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * w.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(part)) for c in batch.columns), lists, model.deviations(x)], schema.fieldNames())

    return mapped(kept, each, schema)


def whiten(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row for each row and component: key, component, n, deviation, whitened, explained, identity_error."""
    model = fit(rows, vector, components)
    each = transform(rows.select(key, vector), model, vector).select(key, "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = F.array(*map(F.lit, model.explained)) if model.values else F.array().cast("array<double>")
    return each.select(
        key, (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"),
    )
