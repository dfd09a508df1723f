"""Substring deduplication by sliding spans of sentences.

A text is cut into sentences after words that end in a stop (``.``, ``!`` or ``?``, with
closing quotes or brackets behind it) and at line ends.  A sentence of over
``LONGEST`` words, such as a list without stops, is cut further after words that a
hash picks.  From every sentence, the shortest run of at least ``RUN`` sentences
and ``WORDS`` words is hashed.  Hashes meet in one aggregation, which gives the
smallest doc_id of each; in all other documents, and for later runs of the same
document, the sentences that a repeated run covers are removed.

A passage may hold no whole run of sentences.  So, of every ``WINDOW`` runs of
``WORDS`` words side by side, wherever they start, the one of least hash takes part
too.  The choice depends on the words of the window alone, so any two texts that
share ``WORDS + WINDOW - 1`` = 50 words share such a run.  If a document before has it,
its words are removed even where they are no whole sentences; ends of a passage of
up to ``WINDOW - 1`` words can stay.  Within one document only runs of sentences count,
so that a word said thirty times stays.

Hashes that occur in one document only, nearly all, are dropped before the join
back by a bitmap of bounded size.  Aggregation needs two numbers for a hash,
however many documents share it, and the join by hash is one that Spark can
split.

Defined results: letters compare without ASCII case and white space as one
space; null texts stay null; texts of fewer words than a run are left alone;
``removed`` holds the sentences (first, end) of repeated runs, ``cut_words`` counts the
words removed besides, and ``n_removed`` the sentences removed whole or in part;
doc_id is whole numbers in their order or anything else in the order of its text;
rows without one come before all others; rows that share a doc_id, or have none,
are in order of a hash of their texts; rows that repeat in id and text are one
document and are treated alike; an empty table gives none; other columns are kept
by ``deduplicate``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .bits import bitmap, inside
from .store import mapped, stash

RUN, WORDS, PICK, WINDOW, LONGEST = 3, 28, 8, 23, 60
_STOPS = np.zeros(256, bool)
_STOPS[[ord(c) for c in ".!?"]] = True
_CLOSERS = np.zeros(256, bool)
_CLOSERS[[ord(c) for c in "\"')]}"]] = True
_U = np.uint64


def _slide(pick, x: np.ndarray, k: int) -> np.ndarray:
    """``pick`` (minimum or maximum) of each k values side by side."""
    if len(x) < k:
        return x[:0]
    size = 1
    while 2 * size <= k:
        x = pick(x[:-size], x[size:])
        size *= 2
    return pick(x[: len(x) - (k - size)], x[k - size :])


def chosen(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of those runs of ``WORDS`` words that are the least of a window."""
    h, at = bs.runs(words, first, WORDS)
    least = _slide(np.minimum, h, WINDOW)
    if not len(least):
        return h[:0], at[:0]
    least[at[WINDOW - 1 :] - at[: len(least)] != WINDOW - 1] = 0  # windows that reach into another text
    edge = np.zeros(WINDOW - 1, _U)
    use = np.flatnonzero(_slide(np.maximum, np.concatenate([edge, least, edge]), WINDOW) == h)
    return h[use], at[use]


def runs(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sentence starts (words), each text's first sentence, of each run its hash, first sentence and end (sentences), word starts (bytes), each text's first word, and hash and first word of each chosen run of words."""
    words, s, e, first = bs.scan(data, offs, bs.SPACED)
    n = len(words)
    if not n:
        none = np.zeros(0, np.int64)
        return none, np.zeros(len(offs), np.int64), np.zeros(0, _U), none, none, none, np.zeros(len(offs), np.int64), np.zeros(0, _U), none
    lines = np.concatenate([[0], np.cumsum(data == 0x0A)])
    last_byte = e - 1
    for _ in range(3):  # behind a stop
        last_byte = np.where(_CLOSERS[data[last_byte]] & (last_byte > s), last_byte - 1, last_byte)
    cut = _STOPS[data[last_byte]]
    cut[:-1] |= lines[s[1:]] > lines[e[:-1]]
    begin = np.zeros(n, bool)
    begin[1:] = cut[:-1]
    begin[first[:-1][first[:-1] < n]] = True
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, n))
    if (size > LONGEST).any():
        picked = (words % _U(PICK) == 0) & np.repeat(size > LONGEST, size)
        begin[1:] |= picked[:-1]
        at = np.flatnonzero(begin)
    owner = np.searchsorted(first, at, "right") - 1
    stop = np.append(at[1:], n)
    last = np.maximum(np.searchsorted(stop, at + WORDS), np.arange(len(at)) + RUN - 1)
    whole = last < len(at)
    whole[whole] = owner[last[whole]] == owner[whole]
    i = np.flatnonzero(whole)
    j = last[i]
    out = np.zeros(len(i), _U)
    step = bs.PIECE
    for a in range(0, len(i), step):  # positions count from the piece's first word, so powers stay few
        p, q = i[a : a + step], j[a : a + step]
        low, high = at[p[0]], stop[q[-1]]
        part = words[low:high]
        power, inverse = bs._power("up", bs._BASE, len(part)), bs._power("down", bs._INVERSE, len(part) + 1)
        total = np.concatenate([np.zeros(1, _U), np.cumsum(part * power, dtype=_U)])
        out[a : a + step] = bs.mix((total[stop[q] - low] - total[at[p] - low]) * inverse[at[p] - low] + (stop[q] - at[p]).astype(_U))
    return at, np.searchsorted(at, first), out, i, j + 1, s, first, *chosen(words, first)


def _key(docs: DataFrame) -> tuple[Column, str]:
    """What orders documents, and its type."""
    if docs.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint"):
        return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "bigint"
    return F.when(F.col("doc_id").isNull(), "").otherwise(F.concat(F.lit("0"), F.col("doc_id").cast("string"))), "string"


def repeated(docs: DataFrame) -> DataFrame:
    """(key, text_hash, hashes): for each document, hashes of its runs that a document before it has."""
    key, kind = _key(docs)

    def each(batch):
        data, offs = bs.column(batch.column(2))
        for i, j in bs.slices(offs):
            _, first, h, at, _, _, start, wh, wat = runs(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            who = np.concatenate([np.searchsorted(first, at, "right"), np.searchsorted(start, wat, "right")]) - 1
            h = np.concatenate([h, wh])
            order = np.lexsort((h, who))
            h, who = h[order], who[order]
            once = np.ones(len(h), bool)
            once[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
            h, who = h[once], who[once]
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(j - i + 1)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), lists], ["key", "text_hash", "hashes"])

    rows = stash(mapped(docs.select(key.alias("key"), F.xxhash64("text").alias("text_hash"), "text"), each, f"key {kind}, text_hash bigint, hashes array<bigint>"), "runs")
    several = stash(rows.groupBy("key").agg(F.min("text_hash").alias("least"), F.max("text_hash").alias("most")).filter("least <> most").select("key"), "several")
    mixed = several.limit(1).count() > 0  # ids that several texts share
    counts = rows.select("key", F.explode("hashes").alias("h")).groupBy("h").agg(F.min("key").alias("first"), F.max("key").alias("last"), *([F.count("*").alias("n")] if mixed else []))
    shared = stash(counts.filter("n > 1" if mixed else "first <> last").select("h", "first"), "shared")
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(shared, "h"))

    def sift(batch):
        lists = batch.column(2)
        flat = lists.flatten().to_numpy().view(np.uint64)
        bound = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        use = inside(flat, *bits.value)
        kept = np.concatenate([[0], np.cumsum(use)])[bound]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(kept.astype(np.int32)), pa.array(flat[use].view(np.int64)))], ["key", "text_hash", "hashes"])

    sifted = mapped(rows, sift, f"key {kind}, text_hash bigint, hashes array<bigint>")
    met = sifted.select("key", "text_hash", F.explode("hashes").alias("h")).join(shared, "h")
    seen = met.filter("key <> first").select("key", "text_hash", "h")
    if mixed:
        met = stash(met.filter("key = first").join(several, "key", "left_semi"), "rivals")
        leader = met.groupBy("h").agg(F.min("text_hash").alias("leader"))
        seen = seen.union(met.join(leader, "h").filter("text_hash <> leader").select("key", "text_hash", "h"))
    return stash(seen.groupBy("key", "text_hash").agg(F.collect_set("h").alias("hashes")), "repeated")


def again(own: np.ndarray, known: np.ndarray | None) -> np.ndarray:
    """Which hashes stand before in the same document or are among the known ones."""
    bad = np.zeros(len(own), bool)
    if len(own) > 1:
        _, once = np.unique(own, return_index=True)
        bad[:] = True
        bad[once] = False
    return bad if known is None else bad | np.isin(own, known)


def covered(low: np.ndarray, high: np.ndarray, n: int) -> np.ndarray:
    """Which of n places lie in one of the ranges."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, low, 1)
    np.add.at(edge, high, -1)
    return np.cumsum(edge[:-1]) > 0


def spans_of(drop: np.ndarray) -> np.ndarray:
    """(first, end) of each stretch."""
    return np.flatnonzero(np.diff(np.concatenate([[False], drop, [False]]).astype(np.int8))).reshape(-1, 2)


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, texts without repeated passages, with n_sentences, n_removed, removed (first, end) sentences and cut_words."""
    seen = repeated(docs).toDF("_key", "_text_hash", "_hashes")
    names = [c for c in docs.columns if c not in ("n_sentences", "n_removed", "removed", "cut_words")]
    rows = docs.select(*names).join(seen, (_key(docs)[0] == F.col("_key")) & (F.xxhash64("text") == F.col("_text_hash")), "left").select(*names, "_hashes")
    text = names.index("text")

    def each(batch):
        for i, j in bs.slices(bs.column(batch.column(text))[1]):
            part = batch.slice(i, j - i)
            data, offs = bs.column(part.column(text))
            begin, first, h, at, end, places, start, wh, wat = runs(data, offs)
            known = part.column(len(names))
            texts, counts, gone, spans, more = [], np.diff(first), np.zeros(j - i, np.int64), [], np.zeros(j - i, np.int64)
            bounds, wbounds = np.searchsorted(at, first), np.searchsorted(wat, start)
            for r in range(j - i):
                a, b = bounds[r], bounds[r + 1]
                c, d = wbounds[r], wbounds[r + 1]
                hashes = known[r].values
                hashes = hashes.to_numpy().view(np.uint64) if hashes is not None and len(hashes) else None
                bad, wbad = again(h[a:b], hashes), np.isin(wh[c:d], hashes if hashes is not None else [])
                if not bad.any() and not wbad.any():
                    texts.append(None)
                    spans.append([])
                    continue
                low, size, base, n = first[r], counts[r], start[r], start[r + 1] - start[r]
                sentences = spans_of(covered(at[a:b][bad] - low, end[a:b][bad] - low, size))
                spans.append([{"first": int(x), "end": int(y)} for x, y in sentences])
                bound = np.append(begin[low : low + size] - base, n)
                whole = covered(bound[sentences[:, 0]], bound[sentences[:, 1]], n)
                drop = whole | covered(wat[c:d][wbad] - base, wat[c:d][wbad] - base + WORDS, n)
                more[r] = (drop & ~whole).sum()
                gone[r] = (np.add.reduceat(drop.astype(np.int64), bound[:-1]) > 0).sum()
                place = np.append(places[base : base + n], offs[r + 1])
                kept, cursor = [], int(offs[r])
                for x, y in spans_of(drop).tolist():
                    kept.append(data[cursor : place[x]].tobytes())
                    cursor = int(place[y])
                kept.append(data[cursor : offs[r + 1]].tobytes())
                texts.append(b"".join(kept).decode())
            changed = pa.array(texts, part.column(text).type)
            columns = part.columns[: len(names)]
            columns[text] = pa.compute.coalesce(changed, columns[text])
            yield pa.RecordBatch.from_arrays([*columns, pa.array(counts.astype(np.int64)), pa.array(gone), pa.array(spans, pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))), pa.array(more)], [*names, "n_sentences", "n_removed", "removed", "cut_words"])

    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in names)
    return mapped(rows, each, f"{schema}, n_sentences bigint, n_removed bigint, removed array<struct<first:int,end:int>>, cut_words bigint")
