"""Personal data by patterns, also where it is disguised, at its place in the source text.

Base spans are the plain patterns' leftmost matches that don't overlap, for each kind; a match that fails its
check (parts of an address up to 255, Luhn's sum, numbers of digits) is dropped and not tried again.

Then the text goes through three transducers.  Each rewrites characters and carries, for every
character it gives out, the range of source characters it stands for:

1. ``letters``: look-alike letters and digits of other scripts become ASCII, invisible ones go;
2. ``marks``: disguised ``@`` and ``.``, in brackets, ``(at)``, ``[dot]``, ``{.}``, or as words between words, ``at``, ``dot``;
3. ``numerals``: digits that are spelled become digits, ``plus`` before one becomes ``+``.

The patterns run over what comes out, and their matches go back to source ranges.  A match is added if a transducer
had a hand in it and no base span of its kind overlaps it; an address of mail may also extend a base
one by a mark in brackets.  ``at`` as a plain word counts only if the domain has a disguised dot too, and a
domain with a plain ``dot`` has to end in a label of DOMAINS: prose such as ``look at example.com`` is left alone.
An added match that lies within a span of another kind is dropped.

Every pattern here takes time in proportion to the text, whatever the text.

Defined results: places count code points, ends are exclusive; null texts are empty; texts have any length;
doc_id may have any type and be null; rows that repeat stay; an empty table gives none; ``find`` and ``redacted``
keep all other columns, and replace one named like their results.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from .store import mapped

#: Order of kinds in results.
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

#: Letters of other scripts that look like ASCII ones.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "օ": "o", "ս": "u",
    "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-", "−": "-", "。": ".", "․": ".", "·": ".", "∙": ".", "•": ".",
}
#: Characters that show nothing.
INVISIBLE = "­᠎​‌‍‎‏⁠⁡⁢⁣⁤﻿"
#: Digits as words in the corpus' languages.
NUMERALS = (
    ("zero", "null", "zéro", "cero"), ("one", "eins", "un", "uno"), ("two", "zwei", "deux", "dos"), ("three", "drei", "trois", "tres"), ("four", "vier", "quatre", "cuatro"),
    ("five", "fünf", "cinq", "cinco"), ("six", "sechs", "seis"), ("seven", "sieben", "sept", "siete"), ("eight", "acht", "huit", "ocho"), ("nine", "neun", "neuf", "nueve"),
)
#: Words for the two marks.
AT_WORDS, DOT_WORDS = ("at", "arroba", "arobase"), ("dot", "punkt", "point", "punto")
#: Last labels that a domain with a plainly spelled dot may have; without those that are words (at, be, in, is, it, me, no, so, to).
DOMAINS = frozenset("com org net edu gov mil int info biz name io ai app dev co tv eu us uk ca au nz de ch fr nl lu es pt mx ar br cl pl cz fi dk ie jp cn kr ru za example test invalid".split())
#: Words that are no name of a domain where both marks are plain words.
NO_NAMES = frozenset("a an the this that these those our your his her its their my each every any some no one and or of in on to is it der die das den dem ein eine le la les un une el los las una y et und".split())

_DIGIT = {w: str(k) for k, words in enumerate(NUMERALS) for w in words}
_WORDS = "|".join(sorted(_DIGIT, key=len, reverse=True))
_MARK = re.compile(
    rf"[ \t]{{0,2}}[\[({{<][ \t]{{0,2}}(?P<b>{'|'.join((*AT_WORDS, '@', *DOT_WORDS, chr(92) + '.'))})[ \t]{{0,2}}[\])}}>][ \t]{{0,2}}"
    rf"|(?<=[A-Za-z0-9])[ \t]{{1,3}}(?P<p>{'|'.join((*AT_WORDS, *DOT_WORDS))})[ \t]{{1,3}}(?=[A-Za-z0-9])",
    re.IGNORECASE,
)
_BRACKETED = re.compile(rf"[\[({{<][ \t]{{0,2}}(?:{'|'.join((*AT_WORDS, '@', *DOT_WORDS, chr(92) + '.'))})[ \t]{{0,2}}[\])}}>]", re.IGNORECASE)
_AT = re.compile(rf"[ \t](?:{'|'.join(AT_WORDS)})[ \t]", re.IGNORECASE)
_DOT = re.compile(rf"[ \t](?:{'|'.join(DOT_WORDS)})[ \t]", re.IGNORECASE)
_SPELLED = re.compile(rf"(?<![^\W_])(?:(?P<plus>plus)(?=[ -]{{1,2}}(?:(?:{_WORDS})(?![^\W_])|[0-9]))|(?P<digit>{_WORDS})(?![^\W_]))", re.IGNORECASE)
_TWO_SPELLED = re.compile(rf"(?<![^\W_])(?:{_WORDS})[ ,.-]{{1,3}}(?:{_WORDS})(?![^\W_])", re.IGNORECASE)
_GAP = re.compile(r"[ -]|, ")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost addresses; before each ``@`` the run of local characters, from the last match on, is gone through once."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        if found:
            start = at
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                out.append((start, found.end()))
                done = found.end()
        at = text.find("@", at + 1)
    return out


def _address(match: str) -> bool:
    parts = [p.lstrip("0") for p in match.split(".")]
    return all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)


def _luhn(match: str) -> bool:
    digits = [int(c) for c in match if c.isdigit()]
    if not 16 <= len(digits) <= 19:
        return False
    return (sum(digits[-1::-2]) + sum(d * 2 - 9 * (d > 4) for d in digits[-2::-2])) % 10 == 0


def _dialled(match: str) -> bool:
    return 8 <= sum(map(str.isdigit, match)) <= 15


_PATTERNS = (("ip", _IP, _address), ("card", _CARD, _luhn), ("phone", _PHONE, _dialled))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind and place."""
    out = [("email", a, b) for a, b in emails(text)]
    for kind, pattern, sound in _PATTERNS:
        if kind != "phone" or "+" in text:
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if m.end() - m.start() > 6 and sound(m.group())]
    return out


@cache
def _table() -> np.ndarray:
    """What each code point below 0x20000 becomes; itself, an ASCII character, or 0xFFFFFFFF for nothing."""
    table = np.arange(0x20000, dtype=np.uint32)
    for c in range(0x80, 0x20000):
        if 0xD800 <= c < 0xE000:
            continue
        plain = unicodedata.normalize("NFKC", chr(c))
        digit = unicodedata.decimal(chr(c), None)
        if len(plain) == 1 and plain.isascii():
            table[c] = ord(plain)
        elif digit is not None:
            table[c] = 0x30 + digit
    for a, b in LOOKALIKES.items():
        table[ord(a)] = ord(b)
    table[[ord(c) for c in INVISIBLE]] = 0xFFFFFFFF
    return table


class View:
    """A rewritten text; character k stands for source characters first[k] to end[k], and ``hand`` tells what made it."""

    PLAIN, LETTER, BRACKET, WORD, NUMERAL = range(5)

    def __init__(self, text: str):
        n = len(text)
        self.text, self.first, self.end, self.hand = text, np.arange(n), np.arange(1, n + 1), np.zeros(n, np.uint8)

    def letters(self) -> None:
        if self.text.isascii():
            return
        codes = np.frombuffer(self.text.encode("utf-32-le"), np.uint32)
        table = _table()
        new = np.where(codes < len(table), table[np.minimum(codes, len(table) - 1)], codes)
        if (new == codes).all():
            return
        keep = new != 0xFFFFFFFF
        at = np.flatnonzero(keep)
        self.text = new[keep].tobytes().decode("utf-32-le")
        # What is invisible belongs to the character before it, so that a span holds no end of one.
        gone = np.diff(np.append(at, len(codes))) > 1
        self.first, self.end = self.first[at], self.end[at]
        self.hand = np.where((new != codes)[keep], View.LETTER, np.where(gone, View.LETTER, View.PLAIN)).astype(np.uint8)

    def rewrite(self, edits: list[tuple[int, int, str, int]]) -> None:
        """Put ``new`` (one character or none) in the place of each (start, end, new, hand)."""
        if not edits:
            return
        texts, first, end, hand, done = [], [], [], [], 0
        for a, b, new, by in edits:
            texts += [self.text[done:a], new]
            for out, own in ((first, self.first), (end, self.end), (hand, self.hand)):
                out.append(own[done:a])
            if new:
                first.append(self.first[a : a + 1])
                end.append(self.end[b - 1 : b])
                hand.append(np.array([by], np.uint8))
            done = b
        texts.append(self.text[done:])
        for out, own in ((first, self.first), (end, self.end), (hand, self.hand)):
            out.append(own[done:])
        self.text, self.first, self.end, self.hand = "".join(texts), np.concatenate(first), np.concatenate(end), np.concatenate(hand)

    def marks(self) -> None:
        edits = []
        for m in _MARK.finditer(self.text):
            word = (m["b"] or m["p"]).lower()
            edits.append((m.start(), m.end(), "@" if word == "@" or word in AT_WORDS else ".", View.BRACKET if m["b"] else View.WORD))
        self.rewrite(edits)

    def numerals(self) -> None:
        edits, last = [], -1
        for m in _SPELLED.finditer(self.text):
            # One space, hyphen or comma between digits that are spelled says nothing.
            if last >= 0 and _GAP.fullmatch(self.text, last, m.start()):
                edits.append((last, m.start(), "", View.NUMERAL))
            edits.append((m.start(), m.end(), "+" if m["plus"] else _DIGIT[m["digit"].lower()], View.NUMERAL))
            last = m.end()
        self.rewrite(edits)


def disguised(text: str) -> View | None:
    """The view of a text that may hold a disguise."""
    view = View(text)
    view.letters()
    marked = _BRACKETED.search(view.text) or (_DOT.search(view.text) and (_AT.search(view.text) or _TWO_SPELLED.search(view.text) or re.search("[0-9]", view.text)))
    spelled = _TWO_SPELLED.search(view.text)
    if not marked and not spelled and view.hand.max(initial=0) == View.PLAIN:
        return None
    if marked:
        view.marks()
    if spelled:
        view.numerals()
    return view


def _mails(view: View) -> list[tuple[int, int]]:
    """Addresses in a view whose disguise is allowed; one that isn't doesn't hide the next."""
    out, done, text, at = [], 0, view.text, view.text.find("@")
    while at >= 0:
        found = _DOMAIN.match(text, at)
        if found:
            end, start = found.end(), at
            dots = view.hand[at + 1 : end][np.frombuffer(text[at + 1 : end].encode(), np.uint8) == 0x2E]
            if (dots == View.WORD).any():  # the words after a domain are no labels
                labels = found.group()[1:].split(".")
                while len(labels) > 1 and labels[-1].lower() not in DOMAINS and dots[len(labels) - 2] == View.WORD:
                    end -= len(labels.pop()) + 1
                dots = dots[: len(labels) - 1]
                fits = len(labels) > 1 and (dots[-1] != View.WORD or labels[-1].lower() in DOMAINS)
                fits = fits and not (view.hand[at] == View.WORD and NO_NAMES.intersection(map(str.lower, labels[:-1])))
            else:
                fits = True
            fits = fits and (view.hand[at] != View.WORD or (dots >= View.BRACKET).any())
            while start > done and text[start - 1] in _LOCAL:
                start -= 1
            if fits and start < at:
                out.append((start, end))
                done = end
        at = text.find("@", at + 1)
    return out


def added_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of identifiers that only show without their disguise."""
    view = disguised(text)
    if view is None:
        return []
    found = [("email", a, b) for a, b in _mails(view)]
    for kind, pattern, sound in _PATTERNS:
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(view.text) if sound(m.group())]
    known: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    for kind, a, b in base:
        known[kind].append((a, b))

    def meets(kind: str, a: int, b: int) -> tuple[int, int] | None:
        own = known[kind]
        k = bisect_right(own, (b, -1)) - 1
        return own[k] if k >= 0 and own[k][1] > a else None

    out = []
    for kind, a, b in found:
        hands = view.hand[a:b]
        if not hands.any():
            continue
        start, end = int(view.first[a]), int(view.end[b - 1])
        met = meets(kind, start, end)
        if met and not (kind == "email" and (hands == View.BRACKET).any() and start <= met[0] and met[1] <= end and (start, end) != met):
            continue
        if any(x and x[0] <= start and end <= x[1] for x in (meets(k, start, end) for k in KINDS if k != kind)):
            continue
        out.append((kind, start, end))
    return out


def spans(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, added) by kind, start and end."""
    base = base_spans(text)
    both = [(*s, False) for s in base] + [(*s, True) for s in added_spans(text, base)]
    return sorted(both, key=lambda s: (KINDS.index(s[0]), s[1], s[2], s[3]))


def covered(text: str, found: list[tuple[str, int, int, bool]]) -> str:
    """The text with each stretch of spans replaced by its first span's kind."""
    out, done = [], 0
    for kind, a, b, _ in sorted(found, key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"[{kind.upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


_FOUND = ArrayType(StructType([StructField("kind", StringType()), StructField("first", IntegerType()), StructField("end", IntegerType()), StructField("added", BooleanType())]))
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("first", pa.int32()), ("end", pa.int32()), ("added", pa.bool_())]))


def _each(docs: DataFrame, redact: bool) -> DataFrame:
    kept = docs.select(*[c for c in docs.columns if c != "found"])
    names = kept.columns
    place, schema = names.index("text"), StructType([*kept.schema.fields, StructField("found", _FOUND)])

    def each(batch):
        rows, texts = [], []
        for v in batch.column(place):
            text = v.as_py()
            found = spans(text) if text else []
            rows.append([{"kind": k, "first": a, "end": b, "added": x} for k, a, b, x in found])
            if redact:
                texts.append(covered(text, found) if found else text)
        columns = list(batch.columns)
        if redact:
            columns[place] = pa.array(texts, columns[place].type)
        return pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW)], schema.fieldNames())

    return mapped(kept, each, schema)


def find(docs: DataFrame) -> DataFrame:
    """``docs`` with ``found``, an array of (kind, first, end, added) by kind and place."""
    return _each(docs, False)


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind in brackets, and with ``found``."""
    return _each(docs, True)


def told(found: str | Column, base: bool = False) -> Column:
    """kind:start:end of spans, comma-joined; ``base``: without those that were added."""
    found = F.col(found) if isinstance(found, str) else found
    some = F.filter(found, lambda s: ~s["added"]) if base else found
    return F.array_join(F.transform(some, lambda s: F.concat_ws(":", s["kind"], s["first"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added); the first four count base spans."""
    rows = find(docs.select("doc_id", "text"))

    def count(kind: str | None) -> Column:
        fits = (lambda s: s["added"]) if kind is None else (lambda s: (s["kind"] == kind) & ~s["added"])
        return F.size(F.filter("found", fits)).cast("long").alias(f"n_{kind or 'added'}")

    base = F.sha2(told("found", base=True).cast("binary"), 256).alias("base_sha256")
    return rows.select("doc_id", *map(count, KINDS), base, told("found").alias("spans"), count(None))
