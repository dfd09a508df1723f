"""The operators of quernel.llm against brute force, libraries and SQL, with hard cases."""

import hashlib
import html as htmllib
import json
import re
import zlib

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from quernel.llm import bytescan, components, decontam, htmlextract, idplanes, jaccard, mixing, piecewise, quality, queries, spandedup, tokencount, toolchat

DOC = "doc_id long, text string, lang string, source string, n_chars long"
HARD = [None, "", " ", "\n", "a", "a b", "a b c", "\x00", "é è", "  lead", "tail  ", "x" * 3000, "word " * 2000, "\t\r\n\x0b\x0c", "A a A a", "日本語 テキスト", "😀 😀", "a b c", "it's 'quoted' 12,3.5", "<|endoftext|> x<|endoftext|>", "▁a ▁ b"]


def documents(spark, texts, start=0):
    rows = [(start + i, t, "en", None if i % 5 == 4 else f"s{i % 3}", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, lowered(t))


# Scanning


def test_scan_equals_regex():
    for members, pattern in ((bytescan.SPACED, r"[^\x20\x09-\x0D]+"), (bytescan.ALNUM, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        data, offs = bytescan.column(pa.array(HARD))
        h, s, e, first = bytescan.scan(data, offs, members)
        raw = bytescan.LOWER[data].tobytes()
        got = [[raw[s[k] : e[k]].decode() for k in range(first[i], first[i + 1])] for i in range(len(HARD))]
        assert got == [words(t, pattern) for t in HARD]
        names = {}
        for w, x in zip([w for g in got for w in g], h.tolist(), strict=True):
            assert names.setdefault(w, x) == x
        assert len(set(names.values())) == len(names)


def test_scan_in_pieces(monkeypatch):
    data, offs = bytescan.column(pa.array(["ab cd " * 50, "x" * 300, "ab"]))
    whole = bytescan.scan(data, offs, bytescan.SPACED)
    monkeypatch.setattr(bytescan, "PIECE", 64)
    assert all(np.array_equal(a, b) for a, b in zip(whole, bytescan.scan(data, offs, bytescan.SPACED), strict=True))


# 1


def test_quality_held_out_accuracy(spark, sf):
    out = quality.classify(read(spark, sf, "documents"), read(spark, sf, "labels")).join(read(spark, sf, "labels"), "doc_id").toPandas()
    assert (out.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in out.doc_id]).all()
    held = out[out.held_out]
    assert (held.predicted == held.quality).mean() > 0.9 and out.score.between(0, 1).all()


def test_quality_hard_cases(spark):
    docs = documents(spark, HARD).withColumn("score", F.lit(7)).withColumn("quality", F.lit(1))
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (3, None, 0), (None, 1, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    out = quality.classify(docs, labels)
    assert out.count() == len(HARD) and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality.classify(docs.limit(0), labels.limit(0)).count() == 0
    assert quality.classify(docs, labels.limit(0)).filter("score <> 0.5").count() == 0
    kept = quality.accepted(docs, labels)
    assert kept.columns == docs.columns


def test_trees_learn_a_rule():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 5)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 3] > 0.6)).astype(float)
    model = quality.grow(x[:1500], y[:1500])
    assert ((model.score(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.97


# 2


def brute_targets(sizes, share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, target, open_ = share * sum(sizes.values()), {}, list(names)
    while True:
        w = sum(weight[s] for s in open_)
        rest = total - sum(target.values())
        over = [s for s in open_ if rest * weight[s] / w > most * sizes[s] + 1e-9]
        if not over:
            return target | {s: rest * weight[s] / w for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            open_.remove(s)


def test_mix(spark, sf):
    docs = read(spark, sf, "documents").withColumn("source", F.when(F.col("doc_id") % 7 != 3, F.col("source")))
    out = mixing.mix(docs).toPandas()
    rows = docs.select("doc_id", "text", "source").toPandas()
    sizes = {i: len(words(t)) for i, t in zip(rows.doc_id, rows.text, strict=True)}
    assert dict(zip(out.doc_id, out["size"], strict=True)) == sizes and len(out) == len(rows)
    by = {}
    for s, i in zip(rows.source, rows.doc_id, strict=True):
        by[s] = by.get(s, 0) + sizes[i]
    want = brute_targets(by)
    for (target, total), g in out.groupby(["target", "source_size"]):
        s = next(k for k, v in want.items() if abs(v - target) < 1e-6 * max(1, v) and by[k] == total)
        assert abs(g.taken.sum() - target) <= g["size"].max(), s
    assert (out.taken <= 2 * out["size"]).all() and (out.taken % out["size"].clip(lower=1) == 0).all()
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert dict(zip(out.doc_id, out.taken, strict=True)) == dict(zip(again.doc_id, again.taken, strict=True))


def test_mix_hard_cases(spark):
    docs = documents(spark, HARD).unionByName(documents(spark, ["one two three"] * 40, 500)).unionByName(documents(spark, ["one two three"] * 3, 500)).withColumn("size", F.lit("x")).withColumn("taken", F.lit(1))
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(HARD) + 43 and (out.taken[out["size"] == 0] == 0).all()
    assert abs(out.taken.sum() - 1.5 * out["size"].sum()) <= 4 * out["size"].max()
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.mix(documents(spark, [None, ""])).agg(F.sum("taken")).first()[0] == 0
    more = mixing.mixed_documents(docs)
    assert more.columns == docs.columns
    have = more.filter("doc_id >= 500").count() * 3
    assert have == out.taken[out.doc_id >= 500].sum()


# 3


def brute_hits(docs, items):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = [(i, tuple(w[k : k + min(10, len(w))])) for i, w in ((i, words(t, pattern)) for i, t in items) if w for k in range(len(w) - min(10, len(w)) + 1)]
    out = {}
    for d, t in docs:
        w, hit, found = words(t, pattern), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit.update(range(k, k + len(win)))
                    found.add(i)
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest())
    return out


def test_decontamination(spark):
    rng = np.random.default_rng(4)
    vocab = [f"w{k}" for k in range(30)] + ["Été", "日本"]
    items = [(k, " ".join(rng.choice(vocab, n))) for k, n in enumerate([0, 1, 2, 4, 5, 9, 10, 11, 25, 25])] + [(77, None), (78, "w1 w2"), (79, "W1, w2!")]
    texts = [" ".join(rng.choice(vocab, 60)) for _ in range(12)] + [" ".join([*rng.choice(vocab, 5), items[8][1].upper(), *rng.choice(vocab, 5)]), items[9][1] + "\n" + items[9][1], items[5][1], None, "", items[7][1] * 3]
    docs = documents(spark, texts).withColumn("h", F.lit(1)).withColumn("win", F.lit("x"))
    got = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string"))
    have = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in got.collect()}
    assert have == brute_hits(list(enumerate(texts)), items)
    none = decontam.decontaminate(docs, spark.createDataFrame([], "item_id long, text string"))
    assert none.filter("contaminated").count() == 0 and none.count() == len(texts)
    assert decontam.without_contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).columns == docs.columns


# 4


def test_token_counts_equal_library(spark, sf):
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = np.random.default_rng(2)
    odd = ["".join(rng.choice(list("abcdetnsr  \n▁é中🎉."), int(n))) for n in rng.integers(1, 700, 150)]
    texts = [*HARD, *odd, "abab" * 300, " " * 500, "①" * 300, "<s> </s>", "ﬁ"]
    docs = documents(spark, texts).select("doc_id", "text").unionByName(read(spark, sf, "documents").select((F.col("doc_id") + 10000).alias("doc_id"), "text")).withColumn("n_tokens", F.lit(0))
    out = tokencount.count_tokens(docs, path).toPandas()
    rows = dict(docs.select("doc_id", "text").toPandas().itertuples(index=False))
    for r in out.itertuples():
        t = rows[r.doc_id] or ""
        n = len(library.encode(t))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 4096), t[:50]
    assert tokencount.count_tokens(docs.limit(0), path).count() == 0


# 5


@pytest.fixture(scope="module")
def net():
    return htmlextract.network()


def test_gradients():
    net = htmlextract.Network(3, 4)
    rng = np.random.default_rng(1)
    x, mask = rng.normal(size=(5, 3, htmlextract.SIZE)).astype(np.float32), np.ones((5, 3), bool)
    mask[3:, 1] = False
    y = rng.integers(0, 2, (5, 3)).astype(np.float32)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    _, grads = net.step(x.astype(np.float64), mask, y)
    for k in net.w:
        i = tuple(rng.integers(0, s) for s in net.w[k].shape)
        old, h = net.w[k][i], 1e-3
        net.w[k][i] = old + h
        up, _ = net.step(x, mask, y)
        net.w[k][i] = old - h
        down, _ = net.step(x, mask, y)
        net.w[k][i] = old
        assert abs((up - down) / (2 * h) - grads[k][i]) < 2e-3 * max(1, abs(grads[k][i])), k


def test_labels_of_generated_pages(net):
    x, first, y = htmlextract.generated(150, 4242)
    assert ((net.label(x, first) >= 0.5) == y).mean() > 0.97


def test_articles_of_pages(spark, sf, net):
    out = htmlextract.extract(read(spark, sf, "pages"), net).toPandas().set_index("page_id")
    rows = read(spark, sf, "pages").toPandas()
    right = 0
    for r in rows.itertuples():
        body = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        parts = re.split(r"</?(?:p|h1|div|li|ul)[^>]*>", body)
        want = "\n".join(z for q in parts if (z := " ".join(htmllib.unescape(re.sub(r"<b>|</b>", "", q.replace("<br>", " "))).split())))
        right += out.text[r.page_id] == want
        assert out.n_chars[r.page_id] == len(out.text[r.page_id])
    assert right >= 0.97 * len(rows)


def test_html_hard_cases(spark, net):
    pages = [None, "", "plain words only", "<p", "<!-- open", "<script>var a='<p>x</p>'", "<p>a &lt; b &amp; c &#233;&nbsp;d</p>", "<div>" * 3000 + "deep", "<p>one<p>two<ul><li>x<li>y</ul>", "<a title='x>y'>link</a>"]
    df = spark.createDataFrame([(i, "u", p, 1) for i, p in enumerate(pages)], "page_id long, url string, html string, text int")
    out = {r["page_id"]: r for r in htmlextract.extract(df, net).collect()}
    assert len(out) == len(pages) and out[0]["text"] == out[1]["text"] == "" and all("var a" not in r["text"] for r in out.values())
    assert [b[1] for b in htmlextract.blocks(pages[6])] == ["a < b & c é d"] and [b[1] for b in htmlextract.blocks(pages[8])] == ["one", "two", "x", "y"]
    assert htmlextract.extract(df.limit(0), net).count() == 0


# 6


@pytest.mark.parametrize("planes", [4, 32])
def test_planes_round_trip(planes):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 70001):
        ids = rng.integers(0, 1 << 32 if n == 7 else 50257, n).astype(np.uint32)
        a, c = idplanes.unpack(idplanes.pack(ids, np.array([n]), planes))
        assert np.array_equal(a, ids) and c.tolist() == [n]
    with pytest.raises(ValueError):
        idplanes.unpack(b"nope" + bytes(40))


def test_ids_equal_library(spark, sf, monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = documents(spark, HARD).select("doc_id", "text").unionByName(read(spark, sf, "documents").select((F.col("doc_id") + 1000).alias("doc_id"), "text")).unionByName(documents(spark, ["same"] * 2, 5).select(F.lit(5).cast("long").alias("doc_id"), "text")).withColumn("ids", F.lit(1))
    out = idplanes.write_and_read(docs, path).orderBy("start").toPandas()
    library, rows = Tokenizer.from_file(path), docs.toPandas()
    want = sorted((i, len(x) + 1, zlib.crc32(np.array([*x, 0], "<u4").tobytes())) for i, t in zip(rows.doc_id, rows.text, strict=True) for x in [library.encode(t or "", add_special_tokens=False).ids])
    assert sorted(zip(out.doc_id, out.n_tokens, out.ids_crc32, strict=True)) == want and out.doc_id.is_monotonic_increasing
    assert out.start.tolist() == [0, *np.cumsum(out.n_tokens)[:-1].tolist()]
    assert idplanes.write_and_read(docs.limit(0), path).count() == 0


# 7


def brute_spans(rows):
    """(n_sentences, n_removed, removed, cut_words, text) of each (id, text), word by word; only the hashes that choose are the operator's."""
    docs = []
    for i, t in rows:
        found = list(re.finditer(r"[^\x20\x09-\x0D]+", t or ""))
        cuts = []
        for k, m in enumerate(found):
            bare = re.sub(r"""(?<=.)["')\]}]{1,3}$""", "", m[0])
            line = k + 1 < len(found) and "\n" in t[m.end() : found[k + 1].start()]
            cuts.append(bare[-1] in ".!?" or line or k + 1 == len(found))
        sentences, at = [], 0
        for k, cut in enumerate(cuts):
            if cut:
                part = list(range(at, k + 1))
                if len(part) > spandedup.LONGEST:
                    for n in part:
                        data = np.frombuffer(found[n][0].encode(), np.uint8)
                        if n == k or int(bytescan.hashes(data, np.array([0]), np.array([len(data)]))[0]) % spandedup.PICK == 0:
                            sentences.append(part[: part.index(n) + 1])
                            part = part[part.index(n) + 1 :]
                else:
                    sentences.append(part)
                at = k + 1
        docs.append((i, t, [(m.start(), m.end()) for m in found], [lowered(m[0]) for m in found], [s for s in sentences if s]))

    def spans(doc):
        _, t, _, ws, sentences = doc
        for a in range(len(sentences)):
            n = 0
            for b in range(a, len(sentences)):
                n += len(sentences[b])
                if n >= spandedup.WORDS and b - a + 1 >= spandedup.RUN:
                    yield "s", a, b, (sentences[a][0], sentences[b][-1])
                    break
        data, offs = bytescan.column(pa.array([t or ""]))
        words_, _, _, first = bytescan.scan(data, offs, bytescan.SPACED)
        h = [int(x) for x in bytescan.runs(words_, first, spandedup.WORDS)[0]]
        for k in sorted({p for q in range(len(h) - spandedup.WINDOW + 1) for p in range(q, q + spandedup.WINDOW) if h[p] == min(h[q : q + spandedup.WINDOW])}):
            yield "w", None, None, (k, k + spandedup.WORDS - 1)

    first, out = {}, []
    for n in sorted(range(len(docs)), key=lambda n: docs[n][0]):
        for kind, _, _, (a, b) in spans(docs[n]):
            first.setdefault(tuple(docs[n][3][a : b + 1]), (n, kind, a))
    for n, (i, t, places, ws, sentences) in enumerate(docs):
        gone, words_gone = set(), set()
        for kind, a, b, (x, y) in spans(docs[n]):
            where = first[tuple(ws[x : y + 1])]
            if where[0] != n or (kind == "s" and where[2] != x):
                (gone if kind == "s" else words_gone).update(range(a, b + 1) if kind == "s" else range(x, y + 1))
        whole = {w for s in gone for w in sentences[s]}
        drop = whole | words_gone
        text, k = "", 0
        while drop and k < len(ws):
            if k in drop:
                while k in drop:
                    k += 1
                continue
            text += t[places[k][0] : places[k + 1][0] if k + 1 < len(ws) else len(t)]
            k += 1
        kept = (t[: places[0][0]] if drop else "") + text
        ranges = [(s, e) for s in sorted(gone) if s - 1 not in gone for e in [next(e for e in range(s + 1, len(sentences) + 1) if e not in gone)]]
        out.append((len(sentences), sum(bool(drop & set(s)) for s in sentences), ranges, len(drop - whole), kept if drop else t))
    return out


def spans_found(docs):
    return [(r["n_sentences"], r["n_removed"], [tuple(x) for x in r["removed"]], r["cut_words"], r["text"]) for r in spandedup.deduplicate(docs).orderBy("at").collect()]


def test_span_dedup(spark):
    rng = np.random.default_rng(7)
    prose = lambda n: " ".join(w + ("." if rng.random() < 0.1 else rng.choice(["", ",", '."', "!)"], p=[0.9, 0.06, 0.03, 0.01])) for w in rng.choice([f"v{k}" for k in range(900)], n))
    shared, plain = prose(60), " ".join(f"p{k}" for k in range(130))
    texts = [prose(120), prose(40) + ". " + shared + " " + prose(40), shared.upper(), prose(30) + "\n" + shared, prose(200), "again. " * 80, *HARD]
    texts += [texts[0], prose(40) + " " + shared, plain, prose(20) + " " + plain[:450] + " " + prose(20), "tail " + plain + " "]
    docs = documents(spark, texts).withColumn("removed", F.lit(0)).withColumn("key", F.lit(0)).withColumn("at", F.col("doc_id"))
    got = spans_found(docs)
    assert got == brute_spans(list(enumerate(texts)))
    assert got[4][4] == texts[4] and got[0][4] == texts[0] and len(got[3][4]) < len(texts[3]) and got[6 + len(HARD)][1] > 0
    assert spandedup.deduplicate(docs.limit(0)).count() == 0
    named = docs.withColumn("doc_id", F.format_string("%05d", "doc_id"))
    assert spans_found(named) == got


def test_span_dedup_rows_that_share_an_id(spark):
    rng = np.random.default_rng(9)
    prose = lambda n: " ".join(w + ("." if rng.random() < 0.12 else "") for w in rng.choice([f"u{k}" for k in range(900)], n))
    shared = prose(80)
    texts = [f"{prose(30)}. {shared}. {prose(30)}." for _ in range(4)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (5, texts[3])]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, at int")
    cut = [r[1] > 0 for r in spans_found(docs)]
    assert cut[1] == cut[2] and cut[0] != cut[1] and cut[3:] == [True] * 3
    alone = spans_found(docs.filter("doc_id = 5"))
    assert [r[1] > 0 for r in alone] in ([True, False, False], [False, True, True])


def test_span_dedup_without_stops(spark):
    """Passages of 51 words without a cut, at all offsets in their texts."""
    vocab = [f"v{k}" for k in range(4000)]
    data = np.frombuffer("".join(vocab).encode(), np.uint8)
    ends = np.cumsum([len(v) for v in vocab])
    vocab = np.array(vocab)[bytescan.hashes(data, np.append(0, ends[:-1]), ends) % np.uint64(spandedup.PICK) != 0]
    rng = np.random.default_rng(5)
    some = lambda n: list(rng.choice(vocab, n))
    first, second = [], []
    for k in range(80):
        shared = some(51)
        first.append(" ".join(some(30) + shared + some(30)))
        second.append((some(k), shared, some(60 - k % 60)))
    docs = documents(spark, first + [" ".join(a + b + c) for a, b, c in second])
    out = {r["doc_id"]: r for r in spandedup.deduplicate(docs).collect()}
    for k, (a, b, c) in enumerate(second):
        left = out[80 + k]["text"].split()
        assert 28 <= out[80 + k]["cut_words"] == 51 + len(a) + len(c) - len(left) <= 51
        assert left[: len(a)] == a and left[len(left) - len(c) :] == c and out[k]["text"] == first[k]


# 8


def test_tool_chat(spark):
    call = lambda i, n, a: "<tool_call>" + json.dumps({"name": n, "id": i, "arguments": a}) + "</tool_call>"
    rows = [
        (1, 0, "user", 'say "x"\n'), (1, 1, "assistant", "ok " + call("a", "search", {"query": "z", "limit": 3, "sites": ["b"]}) + call("b", "search", {"limit": "3", "foo": 1})),
        (1, 2, "tool", '{"tool_call_id":"a","content":{"z":1,"a":[1,2]}}'), (1, 3, "tool", '{"tool_call_id":"b","content":"text"}'), (1, 4, "tool", '{"tool_call_id":"a","content":"more"}'), (1, 5, "tool", '{"tool_call_id":"q","content":"x"}'),
        (2, 0, "tool", '{"tool_call_id":"c","content":"early"}'), (2, 1, "assistant", call("c", "none", {}) + "<tool_call>broken</tool_call>"), (None, 1, "assistant", None), (3, None, None, "x"), (3, 1, "tool", "not json"), (4, 0, "assistant", call("d", "fetch", {"url": "u", "timeout": 1.5, "headers": {}})),
    ]
    m = spark.createDataFrame([(*r, 5) for r in rows], "conv_id long, turn long, role string, text string, call_id int")
    got = toolchat.link(m, toolchat.tool_table(spark)).orderBy("conv_id", "order_turn", "order_phase", "order_call", "turn").collect()
    state = {(r["conv_id"], r["turn"]): (r["state"], r["call_turn"], r["n_calls"], r["n_valid"]) for r in got}
    assert state[1, 1] == ("call", None, 2, 1) and state[1, 2] == ("result", 1, 0, 0) and state[1, 4][0] == "repeated" and state[1, 5][0] == "orphan" and state[3, 1][0] == "orphan" and state[4, 0] == ("call", None, 1, 1)
    assert [r["turn"] for r in got if r["conv_id"] == 2] == [1, 0]
    lines = {(r["conv_id"], r["turn"]): json.loads(r["line"]) for r in got}
    assert all(r["line"] == json.dumps(json.loads(r["line"]), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in got)
    assert lines[1, 1]["tool_calls"][1]["errors"] == ["missing query", "unknown foo", "type limit"] and lines[1, 0]["content"] == 'say "x"\n' and lines[2, 1]["tool_calls"][1]["errors"] == ["unreadable"]
    assert len(got) == len(rows) and toolchat.link(m.limit(0), toolchat.tool_table(spark)).count() == 0


def test_tool_chat_calls_stay_with_their_rows(spark):
    call = lambda i: '<tool_call>{"name":"search","id":"%s","arguments":{"query":"q"}}</tool_call>' % i
    rows = [(None, 1, "assistant", call("a")), (None, 1, "assistant", call("b") + call("c")), (7, 2, "assistant", call("d")), (7, 2, "assistant", "x " + call("e")), (None, 2, "assistant", call("f")), (None, 2, "assistant", call("f"))]
    got = toolchat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), toolchat.tool_table(spark)).collect()
    ids = sorted([c["id"] for c in json.loads(r["line"])["tool_calls"]] for r in got)
    assert ids == [["a"], ["b", "c"], ["d"], ["e"], ["f"], ["f"]] and sorted(r["n_calls"] for r in got) == [1, 1, 1, 1, 1, 2]


def test_tool_chat_keeps_unreadable_calls(spark):
    good = '<tool_call>{"name":"search","id":"a","arguments":{"query":"q"}}</tool_call>'
    texts = [f"one {good} two <tool_call>{{bad $1\n</tool_call>{good} three", "<tool_call></tool_call>", '<tool_call>{"id":"a"}</tool_call> x', good, f"{good}{good}", "<tool_call>open"]
    rows = [(1, k, "assistant", t) for k, t in enumerate(texts)]
    got = toolchat.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), toolchat.tool_table(spark)).collect()
    assert {r["turn"]: json.loads(r["line"])["content"] for r in got} == {k: t.replace(good, "").strip() for k, t in enumerate(texts)}


def brute_problems(schema, v, path=""):
    kinds = schema.get("type", [])
    kinds = [kinds] if isinstance(kinds, str) else kinds
    number = isinstance(v, (int, float)) and not isinstance(v, bool)
    whole = number and float(v).is_integer() and "e" not in repr(v)
    fits = {"string": isinstance(v, str), "integer": whole, "number": number, "boolean": isinstance(v, bool), "array": isinstance(v, list), "object": isinstance(v, dict), "null": v is None}
    if kinds and not any(fits[k] for k in kinds):
        return [f"type {path}"]
    dot, out = f"{path}." if path else "", []
    if "enum" in schema and v not in schema["enum"]:
        out.append(f"enum {path}")
    if number and v < schema.get("minimum", v):
        out.append(f"range {path}")
    if number and v > schema.get("maximum", v):
        out.append(f"range {path}")
    for kind, low, high in ((str, "minLength", "maxLength"), (list, "minItems", "maxItems")):
        if isinstance(v, kind):
            out += [f"length {path}"] * (len(v) < schema.get(low, 0)) + [f"length {path}"] * (len(v) > schema.get(high, 1 << 40))
    if isinstance(v, dict):
        parts = schema.get("properties", {})
        out += [f"missing {dot}{n}" for n in schema.get("required", []) if n not in v]
        if schema.get("additionalProperties") is False:
            out += [f"unknown {dot}{n}" for n in sorted(set(v) - set(parts))]
        for n, part in parts.items():
            if n in v:
                out += brute_problems(part, v[n], f"{dot}{n}")
    if isinstance(v, list) and "items" in schema:
        out += dict.fromkeys(e for x in v for e in brute_problems(schema["items"], x, f"{path}[]"))
    return out


def brute_chat(rows, tools):
    """(conv_id, turn, state, call_turn, order, n_calls, n_valid, line) of each row, one at a time."""
    canonical = lambda v: json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    read, first, answers = {}, {}, {}
    for at, (conv, turn, role, text) in enumerate(rows):
        if role == "assistant" and "<tool_call>" in (text or ""):
            calls = []
            for k, raw in enumerate(re.findall(r"(?s)<tool_call>(.*?)</tool_call>", text)):
                try:
                    c = json.loads(raw)
                    c = c if isinstance(c, dict) else {}
                except ValueError:
                    c = {}
                i, name = c.get("id"), c.get("name")
                errors = ["unreadable"] if i is None or name is None else ["no such tool"] if name not in tools else ["no arguments"] if not isinstance(c.get("arguments"), dict) else brute_problems(tools[name], c["arguments"])
                calls.append({"arguments": c.get("arguments"), "errors": errors, "id": i, "name": name, "valid": not errors, "raw": raw})
                if i is not None and conv is not None and turn is not None:
                    first[conv, i] = min(first.get((conv, i), (turn, k)), (turn, k))
            read[at] = calls
        elif role == "tool":
            try:
                c = json.loads(text)
                c = c if isinstance(c, dict) else {}
            except (ValueError, TypeError):
                c = {}
            answers[at] = (c.get("tool_call_id"), c["content"] if isinstance(c.get("content"), str) else canonical(c["content"]) if "content" in c else text)
    earliest = {}
    for at, (i, _) in answers.items():
        if rows[at][0] is not None and i is not None:
            earliest[rows[at][0], i] = min(earliest.get((rows[at][0], i), rows[at][1]), rows[at][1])
    out = []
    for at, (conv, turn, role, text) in enumerate(rows):
        if at in answers:
            i, content = answers[at]
            call = first.get((conv, i))
            state = "orphan" if call is None else "result" if earliest[conv, i] == turn else "repeated"
            place = (turn, 0, 0) if call is None else (max(turn, call[0]), int(call[0] >= turn), call[1])
            line = {"content": content, "role": role} | ({"tool_call_id": i} if i is not None else {})
            out.append((conv, turn, state, call and call[0], place, 0, 0, canonical(line)))
        elif at in read:
            calls = read[at]
            content = text
            for c in calls:
                if "unreadable" not in c["errors"]:
                    content = content.replace(f"<tool_call>{c['raw']}</tool_call>", "", 1)
            shown = [{k: v for k, v in c.items() if k != "raw"} for c in calls]
            line = {"content": content.strip(" "), "role": role} | ({"tool_calls": shown} if shown else {})
            out.append((conv, turn, "call", None, (turn, 0, 0), len(calls), sum(c["valid"] for c in calls), canonical(line)))
        else:
            out.append((conv, turn, "plain", None, (turn, 0, 0), 0, 0, canonical({"content": text, "role": role})))
    return out


def conversations_with_calls(n, seed=3):
    """Messages of which a fifth of the conversations have calls: clashing ids, early results, repeated rows, null ids, broken calls."""
    rng = np.random.default_rng(seed)
    pick = lambda *v: v[int(rng.integers(len(v)))]

    def value(depth=0):
        kinds = [lambda: int(rng.integers(-5, 50)), lambda: float(np.round(rng.random() * 9, 2)) + 0.001, lambda: pick("", "title", "é x", "body"), lambda: bool(rng.integers(2)), lambda: None]
        if depth < 3:
            kinds += [lambda: [value(depth + 1) for _ in range(rng.integers(0, 4))], lambda: {pick("field", "within", "from", "to", "odd"): value(depth + 1) for _ in range(rng.integers(0, 3))}]
        return kinds[int(rng.integers(len(kinds)))]()

    def arguments(name):
        names = list(toolchat.TOOLS.get(name, {"properties": {"a": 0}})["properties"]) + ["extra"]
        good = {"query": "q", "expression": "1+1", "url": "u", "limit": 3, "digits": 2, "timeout": 1.5, "exact": True, "sites": ["s"], "headers": {}, "filter": {"field": "title", "within": [{"from": 1, "to": None}, {"from": 2}]}}
        bad = {"digits": 99, "timeout": -1, "filter": {"field": "nope"}, "url": ""}
        wrong = lambda k: bad[k] if k in bad and rng.random() < 0.5 else value()
        return {k: good[k] if k in good and rng.random() < 0.7 else wrong(k) for k in names if rng.random() < 0.6}

    rows, conv = [], 0
    while len(rows) < n:
        conv, name = conv + 1, None if rng.random() < 0.02 else conv
        used = []
        for turn in range(int(rng.integers(1, 9))):
            if conv % 5 or rng.random() < 0.3:
                rows.append((name, turn, pick("user", "assistant"), pick("hello", "", 'say "x"', None, "two\nlines")))
            elif rng.random() < 0.5:
                text = pick("", "see ", "é: ")
                for _ in range(int(rng.integers(1, 4))):
                    i, tool = f"c{rng.integers(0, 4)}", pick("search", "search", "fetch", "calculate", "nothing")
                    call = {"id": i, "name": tool, "arguments": arguments(tool)} if rng.random() < 0.9 else pick({"id": i}, {"name": tool, "id": i, "arguments": 3}, [1])
                    used.append(i)
                    text += f"<tool_call>{json.dumps(call, ensure_ascii=False) if rng.random() < 0.93 else '{broken $1'}</tool_call>" + pick("", " then ")
                rows.append((name, turn, "assistant", text))
            else:
                i = pick(*used) if used and rng.random() < 0.7 else f"c{rng.integers(0, 6)}"
                rows.append((name, turn, "tool", pick(json.dumps({"tool_call_id": i, "content": value()}, ensure_ascii=False), "no json", json.dumps({"content": "x"}))))
            if rng.random() < 0.03:
                rows.append(rows[-1])
    return rows[:n]


def test_tool_chat_equals_brute_force(spark):
    rows = conversations_with_calls(6000)
    m = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = sorted(((r["conv_id"], r["turn"], r["state"], r["call_turn"], (r["order_turn"], r["order_phase"], r["order_call"]), r["n_calls"], r["n_valid"], r["line"]) for r in toolchat.link(m, toolchat.tool_table(spark)).collect()), key=repr)
    want = sorted(brute_chat(rows, toolchat.TOOLS), key=repr)
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g == w
    assert sum(r[5] for r in got) > 800 and {e.split()[0] for r in got if r[5] for c in json.loads(r[7])["tool_calls"] for e in c["errors"]} >= {"missing", "unknown", "type", "enum", "range", "length", "unreadable", "no"}


# 9


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} or ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 90 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize("listed,block", [(32, 512), (1, 4)])
def test_jaccard_components(spark, monkeypatch, listed, block):
    monkeypatch.setattr(jaccard, "LISTED", listed)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rng = np.random.default_rng(11)
    vocab = [f"t{k}" for k in range(400)]
    texts = list(HARD)
    for n in (9, 12, 20, 33, 60, 150, 400):
        base = list(rng.choice(vocab, n))
        for k in range(14):
            t = list(base)
            for _ in range(rng.integers(0, max(2, n // 20))):
                t[rng.integers(0, n)] = str(rng.choice(vocab))
            texts.append(" ".join(t[: n - int(rng.integers(0, 1 + n // 15))]))
    texts += [texts[-1].upper(), texts[-2] + " extra", "a b", "A  B", "a b c", "a b c"]
    docs = documents(spark, texts).withColumn("node", F.lit(1)).withColumn("component_id", F.lit(2))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(docs).collect()}
    assert got == brute_components(list(enumerate(texts)))
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r[0] for r in kept.select("doc_id").collect()) == sorted(i for i, (_, c) in got.items() if i == c)


@pytest.mark.parametrize("size,tail,pairs", [(40, 1, 500), (57, 2, 500)])
def test_jaccard_large_buckets(spark, size, tail, pairs):
    """Pairs that only common passages bring together, in buckets over BLOCK; each differs by the most its band allows."""
    middle = " ".join(f"c{k}" for k in range(size - tail))
    texts = [f"x{i} {middle} s{i // 2} " + " ".join(f"y{i}z{k}" for k in range(tail)) for i in range(2 * pairs)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join(documents(spark, texts)).collect()}
    assert got == {i: (size, i - i % 2) for i in range(2 * pairs)}


def test_jaccard_one_component_leaves_no_second_round(spark, monkeypatch):
    """Of many near copies of one text, whose buckets are large, nothing is compared again."""
    monkeypatch.setattr(jaccard, "BLOCK", 64)
    base = [f"b{k}" for k in range(90)]
    texts = [" ".join(base)] + [" ".join([*base[:k], f"n{i}", *base[k + 1 :]]) for i in range(1500) for k in [i % 90]] + ["other " + " ".join(base[:60]) + f" {i} {i + 1} {i + 2} " * 4 for i in range(5)]
    run = jaccard.Join(documents(spark, texts))
    got = {r["doc_id"]: r["component_id"] for r in run.result().collect()}
    assert set(map(got.get, range(1501))) == {0} and all(got[i] != 0 for i in range(1501, 1506))
    assert run.buckets.count() > 10_000 > 30 * run.open.filter("root = node").select("node").distinct().count()
    assert jaccard.BLOCK == 64 and run.open.groupBy("sig").count().filter("count > 1600").count() == 0


def test_jaccard_hard_cases(spark):
    docs = documents(spark, ["one two three four"] * 5).withColumn("doc_id", F.when(F.col("doc_id") < 3, F.col("doc_id")))
    assert sorted(map(tuple, jaccard.join(docs).collect()), key=str) == [(0, 2, 0), (1, 2, 0), (2, 2, 0), (None, 2, 0), (None, 2, 0)]
    assert jaccard.join(docs.limit(0)).count() == 0
    twice = documents(spark, ["one two three four"] * 2).withColumn("doc_id", F.lit(4).cast("long"))
    assert jaccard.one_of_each(twice).count() == 1


def test_one_of_each_decides_by_row(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(4, a), (4, b), (3, a + " more"), (None, b), (None, c), (None, c), (5, c + " more"), (None, "x y z v"), (None, "x y z v"), (7, ""), (7, ""), (None, None), (8, "p q r s"), (8, "p q r s"), (8, "other words of this id")]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, node int")
    kept = [(r["doc_id"], r["text"]) for r in jaccard.one_of_each(docs).collect()]
    want = [(3, a + " more"), (4, b), (5, c + " more"), (None, "x y z v"), (7, ""), (7, ""), (None, None), (8, "p q r s"), (8, "other words of this id")]
    assert sorted(kept, key=str) == sorted(want, key=str)


def test_deletions_find_single_differences():
    plan = jaccard.Plan(10**9)
    assert plan.deleted[:12].max() > 0
    for k in range(3, 25):
        assert plan.segments[k] + plan.deleted[k] == plan.most[k] + 1
    rng = np.random.default_rng(0)
    for n in (12, 15, 18, 30):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            b = np.concatenate([a[:-1], rng.integers(0, 1 << 63, 1).astype(np.uint64)]) if n >= 19 else a[:-1]
            h, first = np.concatenate([np.sort(a), np.sort(b)]), np.array([0, len(a), len(a) + len(b)])
            if 10 * len(np.intersect1d(a, b)) >= 9 * len(np.union1d(a, b)):
                sig, who = jaccard.signatures(h, first, plan)
                assert set(sig[who == 0].tolist()) & set(sig[who == 1].tolist())


def test_components(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(k, k + 1) for k in range(1000, 1040)]
    parent = {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = dict(map(tuple, components.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {x: find(x) for x in got} and set(got) == {x for e in edges if e[0] != e[1] for x in e}


# 10


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_distances():
    rng = np.random.default_rng(1)
    one, two = ([bytes(rng.integers(97, 101, n).astype(np.uint8)) for n in rng.integers(0, 65, 150)] for _ in range(2))
    pad = lambda rows: (np.array([list(r.ljust(64, b"\0")) for r in rows], np.uint8), np.array([len(r) for r in rows]))
    assert piecewise.distances(*pad(one), *pad(two)).tolist() == [levenshtein(a, b) for a, b in zip(one, two, strict=True)]


def test_fingerprints(spark, sf):
    docs = documents(spark, HARD).select("doc_id", "text").unionByName(read(spark, sf, "documents").select((F.col("doc_id") + 100).alias("doc_id"), "text")).withColumn("fingerprint", F.lit(1)).repartition(7)
    out = piecewise.with_next(docs).toPandas().sort_values("doc_id", ascending=False).reset_index(drop=True)
    rows = docs.select("doc_id", "text").toPandas().sort_values("doc_id", ascending=False)
    texts = [t or "" for t in rows.text]
    alone = {t: piecewise.Marks([t.encode()]).strings()[0] for t in texts}
    for k, (t, r) in enumerate(zip(texts, out.itertuples(), strict=True)):
        following = texts[(k + 1) % len(texts)]
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(edited.encode()).hexdigest(), alone[t])
        assert r.edited_fingerprint == piecewise.Marks([edited.encode()]).strings()[0]
        assert 0 <= r.near_edited <= 1 and (r.near_next == 1 if t == following else 0 <= r.near_next <= 1)
    big = out[out.n_chars > 400]
    assert (big.near_edited > big.near_next).mean() > 0.93
    assert piecewise.with_next(docs.limit(1)).first()["near_next"] == 1.0 and piecewise.with_next(docs.limit(0)).count() == 0


# Queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    key = next(k for k in (["doc_id"], ["conv_id", "turn"], ["lang", "rank"]) if set(k) <= set(want))
    got, want = (x[sorted(want.columns)].sort_values(key).reset_index(drop=True) for x in (got, want))
    pd.testing.assert_frame_equal(got, want, check_dtype=False)


def test_pipeline(spark, sf):
    import corpus_pipeline
    from quernel.llm.store import stash

    docs = read(spark, sf, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stash(stage(spark, docs, sf), name)
        sizes.append(docs.count())
        if name != "token_id_planes":
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            parts = brute_components([tuple(r) for r in before.select("doc_id", "text").collect()])
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(i for i, (_, c) in parts.items() if i == c)
        if name == "benchmark_decontamination":
            hits = brute_hits([tuple(r) for r in before.select("doc_id", "text").collect()], [tuple(r) for r in read(spark, sf, "benchmark").collect()])
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(i for i, h in hits.items() if not h[1])
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] and sizes[4] == sizes[5]
    assert corpus_pipeline.run(spark, sf).count() == sizes[5]
