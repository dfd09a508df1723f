"""Operator 11: personal data, plain and disguised."""

import hashlib
import random
import re

import pytest
from quernel.llm import pii, queries

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text: str) -> list[tuple[str, int, int]]:
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            fits = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15,
            }
            if fits[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def card(r: random.Random, n: int) -> str:
    head = "".join(r.choice("0123456789") for _ in range(n - 1))
    return next(head + c for c in "0123456789" if luhn(head + c))


def test_base_spans_equal_plain_patterns():
    r = random.Random(7)
    parts = ["a", "Zz9", "@", ".", "+", "1", "22", "256", "255", "0", " ", "-", "(", ")", "_", "%", "é", "x.y", "b@c.d", "10.0.0.1", "+49 30 1234567", "\n", "4111 1111 1111 1111"]
    for _ in range(4000):
        text = "".join(r.choice([*parts, card(r, r.randint(15, 20))]) for _ in range(r.randint(0, 25)))
        assert pii.base_spans(text) == brute(text), text


WORDS = "lorem thona ipsum ingwer point sat bolane on the dot and one straße d\u2019été niño at two".split()


def spelled(digits: str, r: random.Random) -> str:
    return r.choice([" ", "-"]).join(pii.NUMERALS[int(c)][0] for c in digits)


def wide(text: str) -> str:
    return "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in text)


def disguises(r: random.Random) -> list[tuple[str, str]]:
    name, host = r.choice(["joe", "ann.lee", "k_9"]), r.choice(["example.com", "mail.example.org"])
    dots = lambda s, mark: s.replace(".", mark)
    alike = {v: k for k, v in pii.LOOKALIKES.items()}
    number = str(r.randint(1, 9)) + "".join(r.choice("0123456789") for _ in range(10))
    ip = ".".join(str(r.randint(0, 255)) for _ in range(4))
    return [
        ("email", f"{name}(at){host}"), ("email", f"{name} [at] {dots(host, ' [dot] ')}"), ("email", f"{dots(name, ' dot ')} at {dots(host, ' dot ')}"), ("email", f"{name}@{dots(host, '[.]')}"),
        ("email", f"{name.upper()} AT {dots(host, ' DOT ')}"), ("email", wide(f"{name}@{host}")), ("email", f"{name}@{host}".replace("e", alike["e"])), ("email", f"{name}\u200b@{host}"), ("email", f"{name} arroba {dots(host, ' punto ')}"),
        ("phone", wide("+" + number)), ("phone", "plus " + spelled(number, r)), ("phone", f"+{number[:4]}\u200b{number[4:]}"), ("phone", "+" + number[0] + " " + spelled(number[1:], r)),
        ("card", spelled(card(r, 16), r)), ("card", wide(card(r, 16))), ("card", "".join(chr(0x660 + int(c)) for c in card(r, 17))),
        ("ip", dots(ip, "[.]")), ("ip", dots(ip, " dot ")), ("ip", dots(ip, "(dot)")), ("ip", wide(ip)), ("ip", " dot ".join(spelled(p, r) for p in ip.split("."))),
    ]


def test_disguised_identifiers_come_back_at_their_place():
    r, kinds = random.Random(3), set()
    for _ in range(300):
        for kind, hidden in disguises(r):
            before, after = (" ".join(r.choice(WORDS[:4]) for _ in range(r.randint(1, 5))) for _ in range(2))
            text = f"{before}: {hidden}; {after}"
            assert not any(text[a:b] == hidden for _, a, b in brute(text))
            assert (kind, len(before) + 2, len(before) + 2 + len(hidden)) in [s[:3] for s in pii.spans(text)], text
            kinds.add(kind)
    assert kinds == set(pii.KINDS)


def test_prose_is_left_alone():
    r = random.Random(5)
    for _ in range(2000):
        assert pii.spans(" ".join(r.choice(WORDS) for _ in range(60))) == []
    for text in ("look at example.com", "meet at the dot com", "one two three four five", "3 point 5 (at) home. Then", "page 12 [dot] line", "he is at a point on line 4", "caf\u00e9\u00a0\u2013 2019\u20132020"):
        assert pii.spans(text) == [], text
    near = "call +1 (988) 555-2485 one two"
    assert pii.spans(near) == [("phone", 5, 22, False)]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "+1(", "@a", " ( at", "a@b.", " ", "one ", "one at ", " at a dot", "\u200b", "\uff11"])
def test_very_long_texts(unit):
    text = unit * (1_000_000 // len(unit)) + " joe(at)x(dot)org"
    assert [text[a:b] for k, a, b, x in pii.spans(text) if x and k == "email" and b == len(text)] != [] or unit == "a@b."


def test_query(spark, sf):
    rows = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.QUERIES["op11_personal_data"](spark, sf).collect()
    assert len(got) == len(rows) and sum(r["n_email"] for r in got) > 0
    for r in got:
        base = brute(rows[r["doc_id"]])
        text = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and (r["n_added"] or r["spans"] == text)


def test_hard_rows(spark):
    rows = [(1, None, "x"), (None, "", "y"), (2, "joe [at] x [dot] org, a@b.co", None), (2, "joe [at] x [dot] org, a@b.co", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, found string")
    got = sorted(pii.redacted(docs).select("doc_id", "text", "found").collect(), key=repr)
    assert [r["text"] for r in got if r["doc_id"] == 2] == ["[EMAIL], [EMAIL]"] * 2 and {r["text"] for r in got} == {None, "", "[EMAIL], [EMAIL]"}
    assert pii.digest(docs.limit(0)).collect() == [] and pii.digest(docs).filter("spans = ''").count() == 2
    assert {r["spans"] for r in pii.digest(docs.withColumn("doc_id", docs["doc_id"].cast("string"))).collect()} == {"", "email:0:20,email:22:28"}
