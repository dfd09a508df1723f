"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of whole texts come from numpy passes over their bytes.  The trees
are grown on the driver from at most ``SAMPLE`` labelled rows (those with the
smallest hashes of their ids; the bound is a parameter, the sample is the same
at each run) on quantile bins, then flattened into arrays of features,
thresholds and children.  Scoring moves all rows of a batch down one level of
all trees at a time.  Only the model, of a size that its parameters fix, is sent
to executors.

Defined results: a null or empty text has zero statistics and gets the score of
that; labels that are null are left out, several labels of a document count as
their largest; of labelled rows that share an id the one of least text hash is
learnt from; without labels of both kinds every score is the labels' mean (0.5
without any); rows that repeat stay; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .store import mapped

SAMPLE, TREES, DEPTH, BINS, RATE, LEAST = 20_000, 80, 4, 64, 0.15, 10
_PUNCT = [ord(c) for c in "!\"'(),-.:;?"]
_CLASSES = [range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), [0x20], [0x0A], [ord(c) for c in ".?!"], [ord(","), ord(";"), ord(":")], [ord("!")], [ord("|")], [ord(c) for c in "#$%&*+<=>@\\^_`~{}[]"], [ord("/")], range(0xC2, 0xF5), range(0x80, 0xC0)]
NAMES = [
    *(f"share_{x}" for x in ("upper", "lower", "digit", "space", "newline", "stop", "comma", "bang", "pipe", "symbol", "slash", "lead", "tail")),
    "log_words", "mean_word", "sd_word", "long_words", "short_words", "distinct_words", "distinct_pairs", "distinct_triples", "top_word", "top_four",
    "capital_words", "odd_end_words", "words_per_line", "distinct_lines", "dup_line_bytes", "solid_words", "words_per_stop",
]


def _distinct(h: np.ndarray, who: np.ndarray, n: int, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: distinct values, the count of the commonest, of the four commonest, and the weight of repeats."""
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    counts, owner = np.diff(np.append(at, len(h))), who[at]
    distinct = np.bincount(owner, minlength=n).astype(float)
    by = np.lexsort((-counts, owner))
    place = np.arange(len(by)) - np.searchsorted(owner[by], owner[by])
    top = np.bincount(owner[by][place == 0], counts[by][place == 0], n)
    four = np.bincount(owner[by][place < 4], counts[by][place < 4], n)
    repeats = np.bincount(who[~new], None if weight is None else weight[order][~new], n)
    return distinct, top, four, repeats


def byte_counts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How often each text has each byte; long texts in pieces."""
    out = np.zeros((len(offs) - 1, 256))
    for i, (a, b) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        for k in range(a, b, bs.PIECE):
            out[i] += np.bincount(data[k : min(b, k + bs.PIECE)], minlength=256)
    return out


def statistics(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text."""
    n, size = len(offs) - 1, np.maximum(np.diff(offs), 1).astype(float)
    counts = byte_counts(data, offs)
    cols = [counts[:, list(members)].sum(axis=1) / size for members in _CLASSES]
    words, s, e, first = bs.scan(data, offs, bs.SPACED)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    who = np.repeat(np.arange(n), np.diff(first))
    length = (e - s).astype(float)
    per = lambda x: np.bincount(who, x, n) / some
    mean = per(length)
    spread = np.sqrt(np.maximum(per(length**2) - mean**2, 0))
    distinct, top, four, _ = _distinct(words, who, n)
    shares = []
    for k in (2, 3):
        h, at = bs.runs(words, first, k)
        owner = who[at] if len(at) else np.zeros(0, np.int64)
        shares.append(_distinct(h, owner, n)[0] / np.maximum(np.bincount(owner, minlength=n), 1) if len(h) else np.ones(n))
    head, tail = data[s] if len(s) else np.zeros(0, np.uint8), data[e - 1] if len(e) else np.zeros(0, np.uint8)
    capital = (head >= 0x41) & (head <= 0x5A)
    letter = ((tail | 0x20) >= 0x61) & ((tail | 0x20) <= 0x7A) | (tail >= 0x80)
    odd = ~letter & ~np.isin(tail, _PUNCT)
    lines = np.ones(256, bool)
    lines[0x0A] = False
    ls, le = bs.spans(data, offs, lines)
    owner = np.searchsorted(offs, ls, "right") - 1
    line_count = np.maximum(np.bincount(owner, minlength=n), 1)
    line_distinct, _, _, dup = _distinct(bs.hashes(data, ls, le), owner, n, (le - ls).astype(float))
    stops = np.maximum(cols[5] * size, 1)
    cols += [np.log1p(count), mean, spread, per(length > 14), per(length <= 2), distinct / some, *shares, top / some, four / some, per(capital), per(odd), count / line_count, line_distinct / line_count, dup / size, per(letter), count / stops]
    return np.stack(cols, axis=1).astype(np.float32)


class Trees:
    """Flat arrays of all nodes; a leaf is its own child."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, child: np.ndarray, value: np.ndarray, roots: np.ndarray, depth: int):
        self.base, self.feature, self.threshold, self.child, self.value, self.roots, self.depth = base, feature, threshold, child, value, roots, depth

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        at = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth if len(self.roots) else 0):
            at = self.child[at, (x[row, self.feature[at]] > self.threshold[at]).astype(np.int8)]
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE, least: int = LEAST, ridge: float = 1.0) -> Trees:
    """Newton boosting of the logistic loss on histograms of quantile bins."""
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
    base = math.log(mean / (1 - mean))
    feature, threshold, child, value, roots = [], [], [], [], []
    if len(set(y.tolist())) == 2:
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
        flat = binned + np.arange(x.shape[1]) * bins
        raw = np.full(len(y), base)
        for _ in range(trees):
            p = 1 / (1 + np.exp(-raw))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            roots.append(len(feature))
            todo = [(np.arange(len(y)), 0, None)]
            while todo:
                rows, level, parent = todo.pop()
                node = len(feature)
                if parent is not None:
                    child[parent[0]][parent[1]] = node
                feature.append(0)
                threshold.append(0.0)
                child.append([node, node])
                gs, hs = g[rows].sum(), h[rows].sum()
                value.append(-rate * gs / (hs + ridge))
                best = (1e-6, 0, 0)
                if level < depth and len(rows) >= 2 * least:
                    cells = flat[rows].ravel()
                    k = x.shape[1]
                    hist = [np.bincount(cells, None if w is None else np.repeat(w[rows], k), bins * k).reshape(k, bins).cumsum(axis=1)[:, :-1] for w in (g, h, None)]
                    gl, hl, nl = hist
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(rows) - nl < least)] = -np.inf
                    f, b = np.unravel_index(np.argmax(gain), gain.shape)
                    best = max(best, (float(gain[f, b]), int(f), int(b)), key=lambda z: z[0])
                if best[0] > 1e-6:
                    _, f, b = best
                    feature[node], threshold[node] = f, float(edges[f][min(b, len(edges[f]) - 1)])
                    left = binned[rows, f] <= b
                    todo += [(rows[left], level + 1, (node, 0)), (rows[~left], level + 1, (node, 1))]
                else:
                    raw[rows] += value[node]
    a = lambda v, t: np.array(v, t)
    return Trees(base, a(feature, np.int32), a(threshold, np.float32), a(child, np.int32).reshape(-1, 2), a(value, np.float64), a(roots, np.int64), depth)


def fold(doc_id: str | Column = "doc_id") -> Column:
    """Remainder of crc32(doc_id as text) by 3."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary") if isinstance(doc_id, str) else doc_id) % 3


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from at most ``sample`` labelled rows outside fold 1."""
    known = labels.filter("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    known = known.filter(fold() != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).join(F.broadcast(known), "doc_id")

    def each(batch):
        for i, j in bs.slices(bs.column(batch.column(0))[1]):
            part = batch.slice(i, j - i)
            x = statistics(*bs.column(part.column(0)))
            yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), part.column(3), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))], ["doc_id", "quality", "text_hash", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = mapped(rows.select("text", "doc_id", "quality", "text_hash"), each, f"doc_id {kind}, quality int, text_hash bigint, x array<float>")
    # One row for each id, so that no more than ``sample`` reach the driver.
    found = found.groupBy("doc_id").agg(F.min(F.struct("text_hash", "quality", "x")).alias("r")).select("doc_id", "r.quality", "r.x").toPandas().sort_values("doc_id")
    x = np.array(found["x"].tolist(), np.float32).reshape(-1, len(NAMES))
    return grow(x, found["quality"].to_numpy(np.float64))


def score(docs: DataFrame, model: Trees, name: str = "score") -> DataFrame:
    """The rows of ``docs`` with their score in column ``name``, in place of any that has this name."""
    docs = docs.drop(name)
    names = docs.columns
    text = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def each(batch):
        for i, j in bs.slices(bs.column(batch.column(text))[1]):
            part = batch.slice(i, j - i)
            p = shared.value.score(statistics(*bs.column(part.column(text))))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p)], [*part.schema.names, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return mapped(docs, each, f"{schema}, `{name}` double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    model = train(docs, labels, sample)
    out = score(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps."""
    inner = docs.toDF(*[c if c in ("doc_id", "text") else f"other{i}" for i, c in enumerate(docs.columns)])  # no name clashes
    kept = score(inner, train(docs, labels, sample)).filter("score >= 0.5")
    return kept.drop("score").toDF(*docs.columns)
