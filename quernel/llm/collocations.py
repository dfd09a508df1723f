"""Phrase collocations from sketch bounds and delimiter-guarded automata.

A text is cut into pieces at ``.,;:!?`` and line ends and these into words at spaces
and tabs; A-Z count as a-z.  Everything is told by language (null: ``und``).

1. One scan fills a sketch of pairs of words, a second one a sketch of single words and of
   longer runs whose pairs all may be frequent.  A task counts into one array of cells, so what
   it sends has a fixed size before compression; blocks of cells are summed and
   leave one bit for each cell that reaches ``least``.  A cell is an upper
   bound of each phrase in it, so no frequent phrase is lost.
2. A third scan names the phrases and words whose cells, and those of all their parts, reach
   ``least``, a portion of texts at a time.  What a portion names is compiled into automata, one
   for each language, that run over the portion at once.  Every pattern begins and ends with a
   space, and texts have one space around each word and a comma, which no word can hold, between
   pieces: matches are whole words of one piece, and matches that overlap all count.  Marks are
   the same in all portions, so each names every marked phrase that it holds, and counts
   summed over portions are exact.
3. Counts go out as packed lists, by ranges of hashes, and a range's lists are summed one by one.
4. Thresholds, scores, covers and ranks are joins and aggregations of the exact counts.

Bounds: a sketch has at most ``2 ** MOST_BITS`` cells.  A corpus of over
``MOST_BITS`` cells times ``LOAD`` words is sketched in slices of phrases by hash, one
after the other, each of which has all cells for itself.  A portion ends at ``HELD`` bytes of
texts or ``BLOCK`` bytes of patterns, or with the chunk that passes these, so however many phrases
reach ``least``, a slice takes three scans.  ``counted``, for phrases that the caller has, deals patterns of over ``BLOCK``
bytes to several blocks by hash; every block is broadcast alone and scanned alone.

Defined results: null and empty texts have no words; texts of any length are worked
on in parts cut between pieces; phrases of equal score and count are in order of their
UTF-8 bytes; rows that repeat count again; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import bytescan as bs
from .store import ship, stash, trim

LONGEST, LEAST, COVER, FIRST = 5, 100, 100, 2000
LEAST_BITS, MOST_BITS, BYTES_PER_CELL, LOAD = 18, 26, 16, 16
CELLS, BLOCK, HELD, NAMED, SALTS = 1 << 16, 4 << 20, 32 << 20, 1 << 11, 32
UNKNOWN = "und"
_U = np.uint64
_C = _U(0xD6E8FEB86659FD93)
_STOPS = np.zeros(256, bool)
_STOPS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORDS = ~_STOPS
_WORDS[[0x20, 0x09]] = False
#: A-Z to a-z, tabs to spaces, everything that ends a piece to a comma.
_PLAIN = bytes(0x2C if _STOPS[b] else 0x20 if b == 0x09 else int(bs.LOWER[b]) for b in range(256))

_automata: dict[str, dict] = {}


def chunks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Array]]:
    """Bytes, offsets and languages of a few texts at a time from (lang, text); long texts are cut between pieces."""
    data, offs = bs.column(batch.column(1))
    cuts = [offs]
    for r in np.flatnonzero(np.diff(offs) > bs.PIECE).tolist():
        ends = offs[r] + np.flatnonzero(_STOPS[data[offs[r] : offs[r + 1]]])
        at = np.searchsorted(ends, np.arange(offs[r] + bs.PIECE, offs[r + 1], bs.PIECE))
        cuts.append(np.unique(ends[at[at < len(ends)]]))
    bounds = np.sort(np.concatenate(cuts))
    owner = np.searchsorted(offs, bounds[:-1], "right") - 1
    langs = batch.column(0).take(pa.array(np.minimum(owner, batch.num_rows - 1)))
    for i, j in bs.slices(bounds):
        yield data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], langs.slice(i, j - i)


def words(data: np.ndarray, offs: np.ndarray, langs: pa.Array):
    """Hash of each word within its language, its start and end, its text, and how many words its piece has from it on."""
    h, s, e, first = bs.scan(data, offs, _WORDS)
    if not len(h):
        return h, s, e, s, s
    who = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    names = langs.dictionary_encode()
    seeds = np.array([bs.mix(bs.hashes(b, np.array([0]), np.array([len(b)])))[0] if len(b) else _U(1) for b in (np.frombuffer(x.encode(), np.uint8) for x in names.dictionary.to_pylist())], _U)
    piece = np.cumsum(_STOPS[data])[s]
    last = np.append((piece[1:] != piece[:-1]) | (who[1:] != who[:-1]), True)
    ends = np.flatnonzero(last)
    left = ends[np.searchsorted(ends, np.arange(len(h)))] - np.arange(len(h)) + 1
    return bs.mix(h + seeds[names.indices.to_numpy()[who]]), s, e, who, left


class Sketch:
    """Which cells of hashed phrases may be frequent, among phrases whose first two words belong to slice ``at`` of ``slices``."""

    def __init__(self, bits: int, slices: int = 1, at: int = 0):
        self.bits, self.slices, self.at = bits, slices, at
        self.pairs = self.longer = None

    def cell(self, h: np.ndarray) -> np.ndarray:
        return (h >> _U(64 - self.bits)).astype(np.int64)

    def frequent(self, marks: np.ndarray, h: np.ndarray) -> np.ndarray:
        at = self.cell(h)
        return (marks[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1

    def levels(self, h: np.ndarray, left: np.ndarray, longest: int):
        """(k, starts, hashes) of the runs of k words that take part: all pairs as long as no marks are known, then single words and what these allow."""
        if self.pairs is not None:
            ok = h % _U(self.slices) == _U(self.at) if self.slices > 1 else np.ones(len(h), bool)
            if self.longer is not None:
                ok &= self.frequent(self.longer, h)
            at = np.flatnonzero(ok)
            yield 1, at, h[at]
        if len(h) < 2:
            return
        total = h[:-1] * _C + h[1:]
        mixed = bs.mix(total)
        own = mixed % _U(self.slices) == _U(self.at) if self.slices > 1 else np.ones(len(total), bool)
        ok = own & (left[:-1] >= 2)
        if self.pairs is not None:
            ok &= self.frequent(self.pairs, mixed)
        at = np.flatnonzero(ok)
        yield 2, at, mixed[at]
        for k in range(3, longest + 1 if self.pairs is not None else 3):
            m = len(total) - 1
            if m < 1:
                return
            # The run from the next word on has marks too if this slice tells of it.
            ok = ok[:m] & (ok | ~own)[1:] & (left[:m] >= k)
            total, own = total[:m] * _C + h[k - 1 :], own[:m]
            at = np.flatnonzero(ok)
            mixed = bs.mix(total[at])
            if self.longer is not None:
                held = self.frequent(self.longer, mixed)
                at, mixed = at[held], mixed[held]
                ok = np.zeros(m, bool)
                ok[at] = True
            yield k, at, mixed


def _kind(least: int):
    """The least unsigned type that holds ``least``; cells stop there."""
    return np.uint8 if least < 1 << 8 else np.uint16 if least < 1 << 16 else np.uint32


def _packed(counts: np.ndarray, size: int):
    """(block, bytes) of the blocks that aren't empty."""
    packer = zstandard.ZstdCompressor(level=1)
    for k in range(0, len(counts), size):
        part = counts[k : k + size]
        if part.any():
            yield k // size, packer.compress(np.ascontiguousarray(part).tobytes())


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema)


_SENT = pa.schema([("block", pa.int32()), ("counts", pa.binary()), ("lang", pa.string()), ("n", pa.int64())])


def _summed(sent: DataFrame, kind, size: int, each, schema: str) -> DataFrame:
    """``each(block, sums)`` gives a record batch for every block of counts; a task holds one block's sum at a time."""
    ship(sent.sparkSession)

    def run(batches):
        reader, now, total = zstandard.ZstdDecompressor(), None, None
        for batch in batches:
            for block, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(reader.decompress(data.as_buffer()), kind)
                if block != now:
                    if now is not None:
                        yield each(now, total)
                    now, total = block, np.zeros(size, np.int64)
                total[: len(part)] += part
        if now is not None:
            yield each(now, total)
        trim()

    return sent.select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(run, schema)


def _sketched(docs: DataFrame, sketch: Sketch, longest: int, least: int) -> tuple[np.ndarray, DataFrame]:
    """Marks of the cells that reach ``least``, and (lang, n) words in parts."""
    spark, kind, cells = docs.sparkSession, _kind(least), 1 << sketch.bits
    ship(spark)
    shared = spark.sparkContext.broadcast(sketch)

    def run(batches):
        own, counts, n = shared.value, np.zeros(cells, kind), {}
        for batch in batches:
            for data, offs, langs in chunks(batch):
                h, _, _, who, left = words(data, offs, langs)
                if own.pairs is None and own.at == 0 and len(h):
                    names = langs.dictionary_encode()
                    for name, c in zip(names.dictionary.to_pylist(), np.bincount(names.indices.to_numpy()[who]).tolist()):
                        n[name] = n.get(name, 0) + c
                for k, _, hashes in own.levels(h, left, longest):
                    if own.pairs is None or k != 2:
                        at, c = np.unique(own.cell(hashes), return_counts=True)
                        counts[at] = np.minimum(counts[at].astype(np.int64) + c, least)
        for block, data in _packed(counts, CELLS):
            yield _rows([(block, data, None, None)], _SENT)
        if n:
            yield _rows([(None, None, lang, c) for lang, c in n.items()], _SENT)
        trim()

    sent = stash(docs.mapInArrow(run, "block int, counts binary, lang string, n bigint"), "cells")

    def marked(block, total):
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([np.packbits(total >= least).tobytes()], pa.binary())], ["block", "marks"])

    found = _summed(sent.filter("block is not null"), kind, CELLS, marked, "block int, marks binary").toArrow()
    marks = np.zeros(cells // 8, np.uint8)
    for block, data in zip(found["block"].to_pylist(), found["marks"], strict=True):
        marks[block * CELLS // 8 : (block + 1) * CELLS // 8] = np.frombuffer(data.as_buffer(), np.uint8)
    shared.unpersist()
    return marks, sent.filter("n is not null").select("lang", "n")


def _matched(docs: DataFrame, sketch: Sketch, longest: int, least: int, block_bytes: int) -> DataFrame:
    """(lang, phrase, f): how often each run of words whose cells may be frequent occurs, where that is at least ``least`` times; one scan.

    A portion of texts sends its distinct phrases with their matches as packed lists, by ranges of their hashes, and a range's lists are summed one by one.
    """
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(sketch)
    marked = sum(int(np.bitwise_count(m).sum()) for m in (sketch.pairs, sketch.longer))
    shift = 64 - max(1, int(np.ceil(np.log2(1 + marked / NAMED))))
    schema = pa.schema([("bucket", pa.int32()), ("lang", pa.string()), ("names", pa.binary()), ("counts", pa.binary())])

    def packed(named, texts):
        """Lists of a portion: ``named`` has hashes and phrases of each language, ``texts`` its texts."""
        packer, rows = zstandard.ZstdCompressor(level=3), []
        for lang, found in named.items():
            found.sort(key=lambda xp: (xp[0] >> shift, xp[1]))
            phrases = [p for _, p in found]
            counts, one = np.zeros(len(found), np.int64), automaton(phrases)
            for part in texts[lang]:
                np.add.at(counts, matches(one, [part]), 1)
            buckets = np.array([x >> shift for x, _ in found], np.int64)
            at = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(found)]
            for i, j in pairwise(at):
                rows.append((int(buckets[i]), lang, packer.compress("\n".join(phrases[i:j]).encode()), packer.compress(counts[i:j].tobytes())))
        return _rows(rows, schema)

    def run(batches):
        own, seen, named, texts, size, held = shared.value, set(), {}, {}, 0, 0
        for batch in batches:
            for data, offs, langs in chunks(batch):
                h, s, e, who, left = words(data, offs, langs)
                names, raw = langs.to_pylist(), data.tobytes().lower()
                for k, at, hashes in own.levels(h, left, longest):
                    hashes, first = np.unique(hashes, return_index=True)
                    for x, p in zip(hashes.tolist(), at[first].tolist(), strict=True):
                        if x not in seen:
                            seen.add(x)
                            phrase = b" ".join(raw[s[p] : e[p + k - 1]].split()).decode()
                            named.setdefault(names[who[p]], []).append((x, phrase))
                            size += e[p + k - 1] - s[p] + 2
                parts = {}
                for r, lang in enumerate(names):
                    if offs[r + 1] > offs[r]:
                        parts.setdefault(lang, []).append(raw[offs[r] : offs[r + 1]])
                for lang, own_texts in parts.items():
                    texts.setdefault(lang, []).append(b",".join(own_texts))
                held += len(raw)
                if size >= block_bytes or held >= HELD:
                    yield packed(named, texts)
                    seen, named, texts, size, held = set(), {}, {}, 0, 0
        if named:
            yield packed(named, texts)
        trim()

    def summed(batches):
        reader, now, total = zstandard.ZstdDecompressor(), None, {}

        def told():
            kept = sorted((p, f) for p, f in total.items() if f >= least)
            return pa.RecordBatch.from_arrays([pa.array([now[1]] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()), pa.array([f for _, f in kept], pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for bucket, lang, names, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3), strict=True):
                if (bucket, lang) != now:
                    if now is not None:
                        yield told()
                    now, total = (bucket, lang), {}
                found = np.frombuffer(reader.decompress(counts.as_buffer()), np.int64).tolist()
                for phrase, f in zip(reader.decompress(names.as_buffer()).decode().split("\n"), found, strict=True):
                    total[phrase] = total.get(phrase, 0) + f
        if now is not None:
            yield told()
        trim()

    lists = docs.mapInArrow(run, "bucket int, lang string, names binary, counts binary")
    return stash(lists.repartition("bucket").sortWithinPartitions("bucket", "lang").mapInArrow(summed, "lang string, phrase string, f bigint"), "counts")


def automaton(phrases: list[str], start: int = 0):
    """An automaton of phrases with a space around each; its values are their numbers from ``start`` on."""
    import ahocorasick

    one = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        one.add_word(f" {phrase} ", start + k)
    one.make_automaton()
    return one


def matches(one, parts: list[bytes]) -> np.ndarray:
    """Numbers of the phrases that occur in texts of one language, once for each match."""
    return np.fromiter(map(itemgetter(1), one.iter(guarded(parts))), np.int64)


def built(token: str, entries: dict[str, list[str]]) -> dict:
    """An automaton for each language, made once in a worker: {lang: (automaton, first number)}."""
    if token not in _automata:
        _automata.clear()
        made, start = {}, 0
        for lang, phrases in entries.items():
            made[lang] = automaton(phrases, start)
            start += len(phrases)
        _automata[token] = made
    return _automata[token]


def guarded(parts: list[bytes]) -> str:
    """Texts of one language with one space around each word and a comma between pieces."""
    return f" {b' '.join(b','.join(parts).translate(_PLAIN).replace(b',', b' , ').split()).decode()} "


def counted(docs: DataFrame, phrases: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """(lang, phrase, f): how often each of ``phrases`` (lang, phrase; words joined by one space) occurs in ``docs`` (lang, text)."""
    spark = docs.sparkSession
    ship(spark)
    size = phrases.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    dealt = stash(phrases.withColumn("part", F.pmod(F.xxhash64("lang", "phrase"), F.lit(blocks)).cast("int")), "patterns")
    out = [_counted_block(docs, dealt.filter(F.col("part") == k), 4 * block_bytes) for k in range(blocks)]
    for more in out[1:]:
        out[0] = out[0].union(more)
    return out[0]


def _counted_block(docs: DataFrame, part: DataFrame, most: int) -> DataFrame:
    spark: SparkSession = docs.sparkSession
    if (part.agg(F.sum(F.octet_length("phrase") + 2)).first()[0] or 0) > most:
        raise ValueError("a block of phrases is far over its share")
    rows = part.select("lang", "phrase").distinct().orderBy("lang", "phrase").toArrow()
    entries: dict[str, list[str]] = {}
    for lang, phrase in zip(rows["lang"].to_pylist(), rows["phrase"].to_pylist(), strict=True):
        entries.setdefault(lang, []).append(phrase)
    n, token = rows.num_rows, uuid.uuid4().hex
    shared = spark.sparkContext.broadcast(entries)
    size = CELLS >> 4

    def run(batches):
        automata, counts = None, np.zeros(n, np.int64)
        for batch in batches:
            for data, offs, langs in chunks(batch):
                if automata is None:
                    automata = built(token, shared.value)
                raw, names, parts = data.tobytes(), langs.to_pylist(), {}
                for r, lang in enumerate(names):
                    if lang in automata and offs[r + 1] > offs[r]:
                        parts.setdefault(lang, []).append(raw[offs[r] : offs[r + 1]])
                for lang, texts in parts.items():
                    np.add.at(counts, matches(automata[lang], texts), 1)
        for block, data in _packed(counts, size):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([data], pa.binary())], ["block", "counts"])
        trim()

    sent = stash(docs.mapInArrow(run, "block int, counts binary"), "matches")

    def named(block, total):
        at = np.flatnonzero(total)
        flat = [(lang, p) for lang, ps in shared.value.items() for p in ps][block * size : (block + 1) * size]
        pick = [flat[i] for i in at.tolist()]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in pick], pa.string()), pa.array([p for _, p in pick], pa.string()), pa.array(total[at])], ["lang", "phrase", "f"])

    return stash(_summed(sent, np.int64, size, named, "lang string, phrase string, f bigint"), "counts")


def scored(counts: DataFrame, totals: DataFrame, least: int = LEAST, cover: int = COVER, first: int = FIRST) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) from exact counts (lang, phrase, f) and words (lang, n)."""
    size = F.size(F.split("phrase", " "))
    known = counts.filter(F.col("f") >= least).withColumn("size", size)
    cand = known.filter("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size")
    cuts = cand.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("left"), F.expr("substring_index(phrase, ' ', k - size)").alias("right"))
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(counts.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    cuts = cuts.join(totals, "lang")
    wide = lambda c: f"cast({c} as decimal(19,0))"  # noqa: E731  products of two have 38 digits, which stay exact
    score = F.expr(f"{wide('1000 * a')} * {wide('n')} div ({wide('l')} * {wide('r')})")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # Every shorter phrase inside a longer one, with the longer one's count.
    longer = cand.filter("size > 2").withColumn("w", F.split("phrase", " "))
    inner = longer.withColumn("m", F.explode(F.sequence(F.lit(2), F.col("size") - 1)))
    inner = inner.withColumn("p", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)))
    inner = inner.select("lang", F.array_join(F.slice("w", F.col("p"), F.col("m")), " ").alias("phrase"), "a")
    covered = inner.groupBy("lang", "phrase").agg(F.max("a").alias("longest"))
    kept = best.join(covered, ["lang", "phrase"], "left").filter(f"longest is null or 100 * longest < {cover} * a")
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)).alias("salt"))

    # Ranks in two levels, so that a language's phrases never all meet in one task.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    some = kept.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= first)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= first)
    return top.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def _plan(docs: DataFrame, most_bits: int, load: int) -> tuple[int, int]:
    """Bits of a sketch and slices, by the bytes of all texts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(min(most_bits, max(min(LEAST_BITS, most_bits), np.ceil(np.log2(1 + size / BYTES_PER_CELL)))))
    return max(bits, 16), max(1, -(-size // (BYTES_PER_CELL * load << bits)))


def mine(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, cover: int = COVER, first: int = FIRST, most_bits: int = MOST_BITS, load: int = LOAD, block_bytes: int = BLOCK) -> DataFrame:
    """The best phrases of each language by score; see the module's head."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col("text").cast("string").alias("text"))
    bits, slices = _plan(rows, most_bits, load)
    counts, totals = None, None
    for at in range(slices):
        sketch = Sketch(bits, slices, at)
        sketch.pairs, words_in_parts = _sketched(rows, sketch, longest, least)
        totals = words_in_parts if totals is None else totals
        sketch.longer, _ = _sketched(rows, sketch, longest, least)
        found = _matched(rows, sketch, longest, least, block_bytes)
        counts = found if counts is None else counts.union(found)
    return scored(counts, totals.groupBy("lang").agg(F.sum("n").alias("n")), least, cover, first)
