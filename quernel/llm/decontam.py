"""Benchmark decontamination as a prefix-filtered set join.

An item's windows are ``WINDOW`` consecutive words (a shorter item is one
window).  As a set of shingles, a window occurs in a document only if all its
shingles do, so one of them suffices as its prefix: the one that is rarest over
all documents.  Documents are scanned twice: once to count the shingles that
benchmarks have, once to emit the places of prefix shingles with the words
around them.  These meet the windows in an equi-join, where the window must fit
the document at that offset (length and position) and its words must be equal.

A bitmap of fixed size drops almost all other shingles inside the scan; it
grows with the benchmark up to a bound and then only filters less.

Defined results: null and empty texts have no words and no hits, items without
words have no windows, items without an id make hits but are neither counted nor
listed, rows that repeat are separate documents, and other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .bits import bitmap, inside
from .store import mapped, stash

WINDOW, SHINGLE = 10, 5
NOTHING = hashlib.sha256(b"").hexdigest()


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item_id, win, w, o, h): each window of each item with the offset and hash of each of its shingles."""

    def each(batch):
        data, offs = bs.column(batch.column(1))
        words, s, e, first = bs.scan(data, offs, bs.ALNUM)
        lowered = bs.LOWER[data].tobytes()
        ids, wins, lens, os_, hs = [], [], [], [], []
        for r, item in enumerate(batch.column(0).to_pylist()):
            a, b = int(first[r]), int(first[r + 1])
            w = min(WINDOW, b - a)
            if not w:
                continue
            k = min(SHINGLE, w)
            h, at = bs.runs(words[a:b], np.array([0, b - a]), k)
            texts = [lowered[s[i] : e[i]].decode() for i in range(a, b)]
            for i in range(b - a - w + 1):
                win = " ".join(texts[i : i + w])
                for o in range(w - k + 1):
                    ids.append(item)
                    wins.append(win)
                    lens.append(w)
                    os_.append(o)
                    hs.append(h[i + o])
        yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(wins, pa.string()), pa.array(lens, pa.int32()), pa.array(os_, pa.int32()), pa.array(np.array(hs, np.uint64).view(np.int64))], ["item_id", "win", "w", "o", "h"])

    kind = benchmark.schema["item_id"].dataType.simpleString()
    return mapped(benchmark.select("item_id", "text"), each, f"item_id {kind}, win string, w int, o int, h bigint")


def find(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents (rid, doc_id, text_hash, n_words), matches (rid, start, w, win), and windows of items (win, item_id)."""
    spark = docs.sparkSession
    windows = stash(item_windows(benchmark), "windows")
    sizes = [r[0] for r in windows.select(F.least("w", F.lit(SHINGLE))).distinct().collect()]
    all_bits = spark.sparkContext.broadcast(bitmap(windows, "h"))

    def count(batch):
        data, offs = bs.column(batch.column(0))
        bits, n = all_bits.value
        for i, j in bs.slices(offs):
            words, _, _, first = bs.scan(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], bs.ALNUM)
            found = [h[inside(h, bits, n)] for k in sizes for h in [bs.runs(words, first, k)[0]]]
            h, c = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], ["h", "n"])

    often = mapped(docs.select("text"), count, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n"))
    rated = windows.select("win", "w", "o", "h").distinct().join(often, "h", "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "o")).alias("r")
    prefixes = stash(rated.groupBy("win", "w").agg(rarest).filter("r.n > 0").select("win", "w", "r.h", "r.o"), "prefixes")
    prefix_bits = spark.sparkContext.broadcast(bitmap(prefixes, "h"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    taken = [0]

    def emit(batch):
        data, offs = bs.column(batch.column(2))
        bits, n = prefix_bits.value
        base = TaskContext.get().partitionId() << 40
        for i, j in bs.slices(offs):
            piece, own = data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            words, s, e, first = bs.scan(piece, own, bs.ALNUM)
            places, keys = [], []
            for k in sizes:
                h, at = bs.runs(words, first, k)
                hit = inside(h, bits, n)
                places.append(at[hit])
                keys.append(h[hit])
            at, h = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, keys))
            order = np.argsort(at, kind="stable")
            at, h = at[order], h[order].astype(np.uint64)
            who = np.searchsorted(first, at, "right") - 1
            low = np.maximum(first[who], at - (WINDOW - 1))
            high = np.minimum(first[who + 1], at + WINDOW)
            lowered = bs.LOWER[piece].tobytes() if len(at) else b""
            around = [b" ".join([lowered[s[x] : e[x]] for x in range(a, b)]).decode() for a, b in zip(low.tolist(), high.tolist(), strict=True)]
            found = pa.StructArray.from_arrays([pa.array((at - first[who]).astype(np.int32)), pa.array((low - first[who]).astype(np.int32)), pa.array(h.view(np.int64)), pa.array(around, pa.string())], ["at", "low", "h", "around"])
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(who, np.arange(j - i + 1)).astype(np.int32)), found)
            rid = pa.array(base + taken[0] + np.arange(j - i))
            taken[0] += j - i
            yield pa.RecordBatch.from_arrays([rid, batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(first)), lists], ["rid", "doc_id", "text_hash", "n_words", "found"])

    wanted = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    seen = stash(mapped(wanted, emit, f"rid bigint, doc_id {kind}, text_hash bigint, n_words bigint, found array<struct<at:int,low:int,h:bigint,around:string>>"), "scanned")
    places = seen.select("rid", "n_words", F.explode("found").alias("f")).select("rid", "n_words", "f.*")
    met = places.join(prefixes, "h").withColumn("start", F.col("at") - F.col("o"))
    met = met.filter((F.col("start") >= 0) & (F.col("start") >= F.col("low")) & (F.col("start") + F.col("w") <= F.col("n_words")))
    same = F.array_join(F.slice(F.split("around", " "), F.col("start") - F.col("low") + 1, F.col("w")), " ") == F.col("win")
    matches = stash(met.filter(same).select("rid", "start", "w", "win"), "matches")
    return seen.select("rid", "doc_id", "text_hash", "n_words"), matches, windows.select("win", "item_id").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, spans) for each row of ``docs``."""
    seen, matches, windows = find(docs, benchmark)
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))

    def grow(a, x):
        end = x["start"] + x["w"]
        return F.struct((a["n"] + F.greatest(F.lit(0), end - F.greatest(a["end"], x["start"]))).alias("n"), F.greatest(a["end"], end).alias("end"))

    hits = matches.groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "w"))).alias("spans"))
    hits = hits.withColumn("n_hit", F.aggregate("spans", start, grow)["n"])
    named = matches.select("rid", "win").distinct().join(windows, "win").filter("item_id is not null").select("rid", F.col("item_id").cast("string").alias("item")).distinct()
    items = named.groupBy("rid").agg(F.array_sort(F.collect_list("item")).alias("items")).select("rid", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"))
    out = seen.join(hits, "rid", "left").join(items, "rid", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return out.select("doc_id", "text_hash", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items_sha256", F.lit(NOTHING)).alias("items_sha256"), (n_hit > 0).alias("contaminated"), "spans")


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no window of any item."""
    bad = stash(decontaminate(docs, benchmark).filter("contaminated").select("doc_id", "text_hash").distinct(), "contaminated")
    return docs.join(bad, docs.doc_id.eqNullSafe(bad.doc_id) & (F.xxhash64(docs.text) == bad.text_hash), "left_anti")
