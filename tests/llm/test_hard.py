"""Very long texts, ids of other types, repeated rows and empty tables; plain rewrites of statistics and fingerprints."""

import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quernel.llm import bytescan, decontam, htmlextract, idplanes, jaccard, mixing, piecewise, quality, spandedup, tokencount

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tokenizers():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def long_texts():
    rng = np.random.default_rng(8)
    vocab = [f"w{k}" for k in range(5000)]
    words = rng.choice(vocab, 700_000)
    prose = " ".join(w + ("." if k % 11 == 10 else "") for k, w in enumerate(words.tolist()))  # about 4 MB
    return [prose, "x" * 1_000_000, prose[:200_000] + " tail of its own", "short text of some words"]


def test_long_texts(spark, long_texts, tokenizers):
    """Texts of megabytes and a word of one, whole, through every operator on documents."""
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(long_texts)], DOC).repartition(2)
    docs = docs.select(*docs.columns)
    n = [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in long_texts]
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0), (2, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, labels).filter("score between 0 and 1").count() == 4
    assert sorted(r[0] for r in mixing.mix(docs).select("size").collect()) == sorted(n)
    item = " ".join(re.findall(r"\w+", long_texts[0])[600_000:600_012])
    hits = {r["doc_id"]: r["n_hit"] for r in decontam.decontaminate(docs, spark.createDataFrame([(7, item)], "item_id long, text string")).collect()}
    assert hits[0] == 12 and hits[1] == hits[2] == hits[3] == 0
    cut = {r["doc_id"]: r for r in spandedup.deduplicate(docs).collect()}
    assert cut[0]["text"] == long_texts[0] and cut[1]["text"] == long_texts[1] and len(cut[2]["text"]) < 2000 and cut[2]["text"].endswith("tail of its own")
    shingles = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    w = [re.findall(r"[^\x20\x09-\x0D]+", t.lower()) for t in long_texts]
    assert shingles == {i: (len({tuple(x[k : k + 3]) for k in range(max(len(x) - 2, 1))}), i) for i, x in enumerate(w)}
    chars = {r["doc_id"]: r["n_chars"] for r in piecewise.with_next(docs).collect()}
    assert chars == {i: len(t) for i, t in enumerate(long_texts)}


def test_long_texts_in_tokens(spark, long_texts, tokenizers):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [long_texts[0][:1_500_000], long_texts[1], long_texts[3]]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=tokenizers[1])
    assert {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs, tokenizers[1]).collect()} == {i: len(library.encode(t)) for i, t in enumerate(texts)}
    library = Tokenizer.from_file(tokenizers[0])
    ids = [[*library.encode(t, add_special_tokens=False).ids, 0] for t in texts]
    segments = idplanes.write(docs, tokenizers[0])
    got = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in idplanes.read(segments).collect()}
    assert got == {i: (len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)}
    one = idplanes.documents_of(segments, [2, 1, 99]).collect()
    assert {r["doc_id"]: r["ids"] for r in one} == {1: ids[1], 2: ids[2]}


def test_long_page(spark):
    net = htmlextract.network()
    body = "".join(f"<p>Paragraph {k} of a very long article about the matter at hand, with some more words.</p>" for k in range(20_000))
    rows = spark.createDataFrame([(1, "u", f"<html><body><article>{body}</article></body></html>"), (2, "u", "<p>" + "y" * 1_000_000 + "</p>")], "page_id long, url string, html string")
    out = {r["page_id"]: r for r in htmlextract.extract(rows, net).collect()}
    assert out[1]["n_chars"] > 1_000_000 and out[2]["n_chars"] == 1_000_000
    # A page's only block is its text if it is a paragraph, and not if it is anything that stands around one.
    pages = {"<p>hi you</p>": "hi you", "<html><body><div class='post'><p>hi</p></div></body></html>": "hi", "<footer><p>hi</p></footer>": "", "<div class='menu nav'><p>hi</p></div>": "", "<p><a href='/'>hi</a></p>": "", "<form><p>hi</p></form>": "", "": ""}
    assert htmlextract.texts_of(list(pages), net) == list(pages.values())


def test_ids_of_other_types(spark, tokenizers):
    """Text ids, some missing, and repeated rows."""
    base = "one two three four five six seven eight nine ten eleven. " * 4
    rows = [(f"k{i}", base + f"end {i}", "s") for i in range(4)] + [(None, base + "none", "s"), ("k1", base + "end 1", "s"), ("", "", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string")
    assert mixing.mix(docs).count() == len(rows) and mixing.mixed_documents(docs).columns == docs.columns
    assert spandedup.deduplicate(docs).count() == jaccard.join(docs).count() == piecewise.with_next(docs).count() == len(rows)
    assert tokencount.count_tokens(docs, tokenizers[1]).count() == idplanes.write_and_read(docs, tokenizers[0]).count() == len(rows)
    hits = decontam.decontaminate(docs, spark.createDataFrame([("b", "one two three four five six seven eight nine ten")], "item_id string, text string"))
    assert hits.filter("contaminated").count() == 6
    labels = spark.createDataFrame([("k1", 1), ("k2", 0), (None, 1)], "doc_id string, quality int")
    assert quality.classify(docs, labels).count() == len(rows)


def test_repeated_rows_and_items(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (None, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(5, text), (5, text), (6, text.upper()), (None, text)], "item_id long, text string")
    got = sorted(((r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.decontaminate(docs, items).collect()))
    want = hashlib.sha256(b"5,6").hexdigest()
    assert got == [(0, 0, hashlib.sha256(b"").hexdigest())] + [(12, 2, want)] * 3
    assert decontam.without_contaminated(docs, items).count() == 1
    prints = piecewise.with_next(docs).toPandas()
    assert len(prints) == 4 and prints[prints.n_chars == len(text)].fingerprint.nunique() == 1 and (prints.near_next == 1).sum() >= 1
    pages = spark.createDataFrame([(1, "u", "<p>same</p>")] * 3, "page_id long, url string, html string")
    assert htmlextract.extract(pages, htmlextract.network()).groupBy("text").count().count() == 1


def test_formula_in_an_article():
    page = "<article><h1>T</h1><p>The area is <math><mi>a</mi><mo>=</mo><msup><mi>r</mi><mn>2</mn></msup></math> here.</p><noscript><p>shown without scripts</p></noscript><script>var x</script></article>"
    assert [b[1] for b in htmlextract.blocks(page)] == ["T", "The area is a=r2 here.", "shown without scripts"]


# 1: statistics, one character at a time


def plain_statistics(t):
    raw = t.encode()
    n, size = len(raw), max(len(raw), 1)
    kinds = [lambda b: 65 <= b <= 90, lambda b: 97 <= b <= 122, lambda b: 48 <= b <= 57, lambda b: b == 32, lambda b: b == 10, lambda b: chr(b) in ".?!", lambda b: chr(b) in ",;:", lambda b: b == 33, lambda b: chr(b) == "|", lambda b: chr(b) in "#$%&*+<=>@\\^_`~{}[]", lambda b: b == 47, lambda b: 0xC2 <= b < 0xF5, lambda b: 0x80 <= b < 0xC0]
    out = [sum(map(k, raw)) / size for k in kinds]
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    low = [w.lower() for w in words]
    some = max(len(words), 1)
    lengths = [len(w) for w in words]
    mean = sum(lengths) / some
    counts = sorted((low.count(w) for w in set(low)), reverse=True)
    letter = lambda b: chr(b).isascii() and chr(b).isalpha() or b >= 0x80
    lines = [x for x in raw.split(b"\n") if x]
    folded, seen, repeats = [x.lower() for x in lines], set(), 0
    for x in folded:
        repeats += len(x) if x in seen else 0
        seen.add(x)
    grams = lambda k: [tuple(low[i : i + k]) for i in range(len(low) - k + 1)]
    share = lambda g: len(set(g)) / len(g) if g else (1.0 if len(low) == 0 else 0.0)
    out += [
        math.log1p(len(words)), mean, math.sqrt(max(sum(v * v for v in lengths) / some - mean**2, 0)), sum(v > 14 for v in lengths) / some, sum(v <= 2 for v in lengths) / some,
        len(set(low)) / some, share(grams(2)), share(grams(3)), sum(counts[:1]) / some, sum(counts[:4]) / some,
        sum(65 <= w[0] <= 90 for w in words) / some, sum(not letter(w[-1]) and chr(w[-1]) not in "!\"'(),-.:;?" for w in words) / some, len(words) / max(len(lines), 1), len(seen) / max(len(lines), 1), repeats / size,
        sum(letter(w[-1]) for w in words) / some, len(words) / max(sum(map(kinds[5], raw)), 1),
    ]
    assert n == len(raw)
    return out


def test_statistics_equal_plain_counts():
    texts = ["The cat sat. The cat ran!\nThe cat sat. The cat ran!\nIt's over; é è 12,3 | a/b #x", "word " * 30, "A\n\nA\nb", "\x00 odd\ttabs", "Ünïcode straße 日本語 " * 5, "one"]
    got = quality.statistics(*bytescan.column(pa.array(texts)))
    for t, row in zip(texts, got, strict=True):
        want = plain_statistics(t)
        for name, a, b in zip(quality.NAMES, row.tolist(), want, strict=True):
            if name in ("distinct_pairs", "distinct_triples") and len(t.split()) < 3:
                continue  # too few words for one
            assert a == pytest.approx(b, rel=1e-5, abs=1e-6), (name, t)


# 10: a rolling hash, one byte at a time


def plain_fingerprint(t):
    raw, mask = t.encode(), (1 << 32) - 1

    def level(i):
        h = 0
        for d in range(piecewise.WINDOW):
            if i - d >= 0:
                h = (h + int(piecewise._ROLL[raw[i - d]]) * pow(0x01000193, d, 1 << 32)) & mask
        h ^= h >> 15
        h = (h * 0x2C1B3C6D) & mask
        h ^= h >> 12
        return 31 if h == 0 else min(31, (h & -h).bit_length() - 1)

    levels = [level(i) for i in range(len(raw))]
    k = next((k for k in range(31, piecewise.LEAST_K, -1) if sum(v >= k for v in levels) >= piecewise.HALF), piecewise.LEAST_K)

    def letter(piece):
        h, power = 0, 1
        for b in piece:
            h = (h + int(bytescan._BYTE[b]) * power) % (1 << 64)
            power = power * int(bytescan._BASE) % (1 << 64)
        h = (h + len(piece)) % (1 << 64)
        h ^= h >> 33
        h = h * 0xFF51AFD7ED558CCD % (1 << 64)
        h ^= h >> 33
        h = h * 0xC4CEB9FE1A85EC53 % (1 << 64)
        h ^= h >> 33
        return "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[h >> 58]

    def signature(k):
        cuts = [i + 1 for i, v in enumerate(levels) if v >= k][: piecewise.FULL - 1]
        bounds = [0, *cuts] + ([len(raw)] if not cuts or cuts[-1] < len(raw) else [])
        return "".join(letter(raw[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b > a)

    return f"{1 << k}:{signature(k)}:{signature(k + 1)}"


def test_fingerprints_equal_a_plain_rolling_hash():
    rng = np.random.default_rng(6)
    texts = ["", "a", "ab" * 5, "日本語 straße", "\x00\x00x", *["".join(rng.choice(list("abcdefgh ij\n"), n)) for n in (30, 120, 300, 1000, 5000, 20000)], "same " * 4000]
    got = piecewise.Marks([t.encode() for t in texts]).strings()
    assert got == [plain_fingerprint(t) for t in texts]
    full = [g for g in got if piecewise.FULL in map(len, g.split(":")[1:])]
    assert full  # at least one whose last character stands for all the rest


# The pipeline


def test_stages_on_hard_tables(spark, tmp_path):
    import corpus_pipeline

    columns = "doc_id long, text string, lang string, source string, n_chars long, _mix_sz int, _quality_score int, copies int, node long"
    rows = [(None, None, None, None, None, 1, 2, 3, 4), (1, "", "en", None, 0, 1, 2, 3, 4), (2, "some words of a text", "en", "s", 5, 1, 2, 3, 4), (2, "some words of a text", "en", "s", 5, 1, 2, 3, 4), (None, "some words of a text", "en", "s", 5, 1, 2, 3, 4)]
    for docs in (spark.createDataFrame([], columns), spark.createDataFrame(rows, columns)):
        for empty in (True, False) if docs.count() else (True,):
            d = str(tmp_path / f"{docs.count()}{empty}")
            labels = spark.createDataFrame([] if empty else [(2, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
            items = spark.createDataFrame([] if empty else [(1, "nothing of the kind"), (None, None)], "item_id long, text string")
            labels.write.parquet(f"{d}/labels.parquet")
            items.write.parquet(f"{d}/benchmark.parquet")
            docs.write.parquet(f"{d}/documents.parquet")
            for name, stage in corpus_pipeline.STAGES:
                out = stage(spark, docs, d)
                if name != "token_id_planes":
                    assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes], name
                    assert name == "source_mix" or set(map(tuple, out.collect())) <= set(map(tuple, docs.collect())), name
                else:
                    assert out.count() == docs.count()
    assert corpus_pipeline.run(spark, d).count() >= 0


def test_mix_stage_equals_its_plan(spark, sf):
    """Each document comes as often as the mix says, with its own text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r["doc_id"]: r["copies"] for r in mixing.mix(docs).collect() if r["copies"]}
    got = mixing.mixed_documents(docs).groupBy("doc_id", F.xxhash64("text").alias("h")).count()
    assert {r["doc_id"]: r["count"] for r in got.collect()} == want
    assert got.join(docs.select("doc_id", F.xxhash64("text").alias("h")), ["doc_id", "h"], "left_anti").count() == 0


def test_labels_without_telling_names(monkeypatch):
    """Pages whose main block is a plain div with no class, or one that says nothing."""
    from quernel.llm import pagemaker

    monkeypatch.setitem(pagemaker.TAGS, "main", "div")
    monkeypatch.setitem(pagemaker.NAMES, "main", "wrapper container row box x7f2a")
    x, first, y = htmlextract.generated(150, 777)
    right = (htmlextract.network().label(x, first) >= 0.5) == y
    print("blocks labelled right without telling names:", right.mean())
    assert right.mean() > 0.93


def test_scope_removes_what_was_stashed(spark, tmp_path):
    from quernel.llm import store

    def files():
        top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{store.folder(spark)}/quernel/{spark.sparkContext.applicationId}")
        fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return fs.getContentSummary(top).getFileCount() if fs.exists(top) else 0

    before = files()
    docs = spark.createDataFrame([(1, "a b c d"), (2, "a b c d"), (3, None)], "doc_id long, text string")
    with store.scope(spark):
        jaccard.join(docs).write.parquet(str(tmp_path / "out"))
        with store.scope(spark):
            inner = store.stash(docs, "inner")
        assert files() > before
    assert files() == before and {r["component_id"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1, 3}
    with pytest.raises(Exception, match="(?i)not exist|not found"):
        inner.collect()
