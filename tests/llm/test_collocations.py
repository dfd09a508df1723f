"""Operator 13: phrase collocations."""

import random
import re
from collections import Counter

import pytest
from quernel.llm import collocations, queries


def counts(rows, longest=5):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            ws = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, " ".join(ws[i : i + k])) for i in range(len(ws) - k + 1))
    return n, f


def brute(rows, least=100, cover=100, first=2000, longest=5):
    n, f = counts(rows, longest)
    cand = {k: a for k, a in f.items() if a >= least and " " in k[1]}
    covered = Counter()
    for (lang, phrase), a in cand.items():
        ws = phrase.split(" ")
        for m in range(2, len(ws)):
            for i in range(len(ws) - m + 1):
                key = lang, " ".join(ws[i : i + m])
                covered[key] = max(covered[key], a)
    out = {}
    for (lang, phrase), a in cand.items():
        if 100 * covered[lang, phrase] >= cover * a:
            continue
        ws, best = phrase.split(" "), None
        for k in range(1, len(ws)):
            l, r = f[lang, " ".join(ws[:k])], f[lang, " ".join(ws[k:])]
            cut = (1000 * a * n[lang] // (l * r), k, l, r)
            best = cut if best is None or cut < best else best
        out.setdefault(lang, []).append((-best[0], -a, phrase.encode(), phrase, a, best[2], best[3], n[lang], best[0]))
    return sorted((lang, k + 1, *x[3:]) for lang, xs in out.items() for k, x in enumerate(sorted(xs)[:first]))


def texts(count=300, seed=1):
    r, rows = random.Random(seed), []
    base = ["a", "b", "Bb", "c,", "d", "e.", "É", "f\tg", "a  a", "x\ny", "\u00a0", "zz", "\x00q", "h;h"]
    for k in range(count):
        words = [r.choice(base) for _ in range(r.randint(0, 80))]
        for _ in range(r.randint(0, 3)):
            at = r.randint(0, len(words))
            words[at:at] = ["New", "York", "City", "Hall"][: r.randint(2, 4)]
        rows.append((r.choice(["en", "en", "de", None, "und", ""]), " ".join(words)))
    return [*rows, (None, None), ("fr", ""), ("en", "a " * 3000), ("en", "a " * 3000)]


def mined(spark, rows, **more):
    docs = spark.createDataFrame([(k, t, lang, k % 2) for k, (lang, t) in enumerate(rows)], "doc_id long, text string, lang string, n long").repartition(5)
    return sorted(tuple(r) for r in collocations.mine(docs, **more).collect())


def test_equals_brute_force(spark):
    rows = texts()
    want = brute(rows, least=20)
    assert len(want) > 50 and {w[0] for w in want} >= {"en", "de", "und"}
    assert mined(spark, rows, least=20) == want
    assert mined(spark, rows, least=20, first=7, cover=60) == brute(rows, least=20, first=7, cover=60)


@pytest.mark.parametrize("more", [{"most_bits": 16, "load": 1}, {"block_bytes": 300}, {"most_bits": 16, "load": 1, "block_bytes": 700}])
def test_slices_and_blocks_lose_nothing(spark, more):
    rows = texts(200, 2) * (60 if "most_bits" in more else 1)
    if "most_bits" in more:
        size = sum(len((t or "").encode()) for _, t in rows)
        assert size > collocations.BYTES_PER_CELL << 16
    assert mined(spark, rows, least=300, **more) == brute(rows, least=300)


def test_scans_do_not_grow_with_patterns(spark):
    """However many blocks the patterns fill, the texts are scanned as often."""
    rows, jobs = texts(200, 3), {}
    for name, more in (("one", {}), ("many", {"block_bytes": 300})):
        spark.sparkContext.setJobGroup(f"scans {name}", name)
        assert mined(spark, rows, least=20, **more) == brute(rows, least=20)
        jobs[name] = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"scans {name}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert 0 < jobs["many"] <= jobs["one"] + 3, jobs


def test_words_count_where_no_phrase_is(spark):
    """A word of a frequent phrase is counted in texts that name none of its phrases too."""
    rows = [("en", "red fox")] * 30 + [("en", f"red x{k}") for k in range(40)] + [("en", f"y{k}, fox") for k in range(25)] + [("de", "red")] * 9
    docs = spark.createDataFrame([(lang, t) for lang, t in rows], "lang string, text string").repartition(7)
    assert [tuple(r) for r in collocations.mine(docs, least=30, block_bytes=1).collect()] == brute(rows, least=30) == [("en", 1, "red fox", 30, 70, 55, 190, 1480)]


def test_overlaps_count(spark):
    docs = spark.createDataFrame([("en", "a a a a, a a"), ("de", "a a")], "lang string, text string")
    asked = spark.createDataFrame([("en", "a a"), ("en", "a"), ("de", "a a"), ("en", "a b"), ("de", "a")], "lang string, phrase string")
    assert {tuple(r) for r in collocations.counted(docs, asked).collect()} == {("en", "a a", 4), ("en", "a", 6), ("de", "a a", 1), ("de", "a", 2)}


def test_long_text_is_cut_between_pieces(spark):
    long = ("one two three four five six. " * 30000) + "seven eight " * 40000
    rows = [("en", long), ("de", "one two"), ("en", "x" * 2_000_000)]
    assert mined(spark, rows, least=1000) == brute(rows, least=1000)


def test_products_beyond_64_bits(spark):
    big = 3 * 10**9
    counts_ = spark.createDataFrame([("en", "a b", big), ("en", "a", 2 * big), ("en", "b", big + 1)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", 9 * 10**15)], "lang string, n long")
    row = collocations.scored(counts_, totals).first()
    assert row["score"] == 1000 * big * 9 * 10**15 // (2 * big * (big + 1))


def test_empty(spark):
    docs = spark.createDataFrame([], "lang string, text string")
    assert collocations.mine(docs).collect() == [] and collocations.mine(docs.union(spark.createDataFrame([(None, None)], docs.schema))).collect() == []


def test_query(spark, sf):
    rows = [(r["lang"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("lang", "text").collect()]
    got = sorted(tuple(r) for r in queries.QUERIES["op13_phrase_collocations"](spark, sf).collect())
    assert got == brute(rows) and len(got) > 10
