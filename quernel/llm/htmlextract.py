"""Main text of web pages by a recurrent block labeller.

A page is cut at block-level tags into leaf blocks.  Each gets a vector: hashed
names of the tags, classes and ids on its path, hashed words, and some measures
of its shape.  A bidirectional LSTM in numpy reads all vectors of a page, so that
every block is labelled in the context of the whole document, and the blocks
labelled main text are kept.  The network is trained on the driver, from a fixed
seed, on ``PAGES`` generated pages; its weights have a fixed size and are all
that executors get.

Inline tags and formulas don't cut; ``br`` is white space; scripts, styles, templates,
head, form controls, drawings, frames and comments have no blocks, and all other
text is left to the labeller; elements that HTML closes by itself are closed.

Defined results: null, empty or text-free html gives an empty text; rows that
repeat stay; a page of any length is read whole; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import bytescan as bs
from .pagemaker import NAMES, PageMaker
from .store import mapped

PATH, WORDS, SHAPE, HIDDEN, PAGES, EPOCHS, SEED = 256, 32, 8, 20, 700, 10, 11
SIZE = PATH + WORDS + SHAPE

# Fixed values of the HTML standard: elements that are part of a line, that are empty, whose content isn't text, that end others.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr output math mi mn mo mrow msub msup msubsup mfrac msqrt mroot mtext mstyle mspace mover munder semantics annotation".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN_TEXT = frozenset("script style template head title svg iframe textarea select option button".split())
RAW = frozenset("script style textarea title iframe".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = frozenset("ul ol dl table".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:"[^"]*"|'[^']*'|[^'">]++)*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_NAME = re.compile(r"[a-z]+")


def _tokens(tag: str, attrs: str) -> tuple[str, ...]:
    if not attrs or "=" not in attrs:
        return (tag,)
    words = [w for m in _ATTR.finditer(attrs) for w in _NAME.findall(m[1].lower())]
    return (tag, *("." + w for w in words))


def blocks(page: str) -> list[tuple[tuple, str, int]]:
    """(path, text, characters in links) of each leaf block that has text, in page order."""
    out, stack, hold, linked, links, hidden, at = [], [], [], 0, 0, 0, 0
    path: tuple = ()

    def flush():
        nonlocal hold, linked
        if hold:
            text = " ".join(html.unescape("".join(hold)).split())
            if text:
                out.append((path, text, min(linked, len(text))))
            hold, linked = [], 0

    def pop_to(i):
        nonlocal hidden, path
        flush()
        hidden -= sum(t in HIDDEN_TEXT for t, _ in stack[i:])
        del stack[i:]
        path = tuple(p for _, p in stack)

    size = len(page)
    while at < size:
        m = _TAG.search(page, at)
        stop = m.start() if m else size
        if stop > at and not hidden:
            piece = page[at:stop]
            hold.append(piece)
            if links:
                linked += len(piece)
        if not m:
            break
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        tag, closing, attrs = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if tag in INLINE:
            if tag == "br":
                hold.append(" ")
            elif tag == "a":
                links = 0 if closing else 1
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    pop_to(i)
                    break
            else:
                flush()
            links = 0
            continue
        flush()
        if tag in EMPTY:
            continue
        for i in range(len(stack) - 1, -1, -1):
            t = stack[i][0]
            if t == "p" or t in ENDS.get(tag, ()):
                pop_to(i)
                break
            if t in _FENCE:
                break
        if tag == "body":
            for i, (t, _) in enumerate(stack):
                if t == "head":
                    pop_to(i)
                    break
        if tag in HIDDEN_TEXT:
            hidden += 1
        stack.append((tag, _tokens(tag, attrs)))
        path = tuple(p for _, p in stack)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(page, at)
            at = end.start() if end else size
    flush()
    return out


_paths: dict[tuple, np.ndarray] = {}


def _path_slots(path: tuple) -> np.ndarray:
    found = _paths.get(path)
    if found is None:
        if len(_paths) > 50_000:
            _paths.clear()
        names = {t for step in path for t in step} | {"leaf " + t for step in path[-1:] for t in step}
        found = _paths[path] = np.array(sorted({zlib.crc32(t.encode()) % PATH for t in names}), np.int64)
    return found


def vectors(found: list[list[tuple[tuple, str, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of all blocks of some pages, and the index of each page's first block."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    first = np.concatenate([[0], np.cumsum(sizes)])
    flat = [b for page in found for b in page]
    out = np.zeros((len(flat), SIZE), np.float32)
    if not flat:
        return out, first
    for r, (path, _, _) in enumerate(flat):
        out[r, _path_slots(path)] = 1
    raw = [t.encode() for _, t, _ in flat]
    offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))])
    data = np.frombuffer(b"".join(raw), np.uint8)
    words, s, e, w = bs.scan(data, offs, bs.SPACED)
    n = np.diff(w)
    who = np.repeat(np.arange(len(raw)), n)
    some = np.maximum(n, 1)
    count = np.bincount(who * WORDS + (words % np.uint64(WORDS)).astype(np.int64), minlength=len(raw) * WORDS).reshape(-1, WORDS)
    out[:, PATH : PATH + WORDS] = np.sqrt(count / some[:, None])
    length = np.diff(offs)
    tail = data[e - 1] if len(e) else np.zeros(0, np.uint8)
    ends = np.bincount(who, np.isin(tail, [0x2E, 0x21, 0x3F, 0x2C]), len(raw)) / some
    page = np.repeat(np.arange(len(found)), sizes)
    place = (np.arange(len(flat)) - first[page]) / np.maximum(sizes[page] - 1, 1)
    linked = np.fromiter((l / max(1, len(t)) for _, t, l in flat), np.float64, len(flat))
    out[:, PATH + WORDS :] = np.stack([np.log1p(length) / 8, np.log1p(n) / 6, ends, linked, place, 1 - place, length < 30, np.ones(len(flat))], axis=1)
    return out, first


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Bidirectional LSTM with a logistic output for each block."""

    def __init__(self, seed: int = SEED, hidden: int = HIDDEN):
        r = np.random.default_rng(seed)
        h = hidden
        self.w = {}
        for d in ("f", "b"):
            self.w["x" + d] = r.normal(0, 0.12, (SIZE, 4 * h)).astype(np.float32)
            self.w["h" + d] = r.normal(0, 0.2, (h, 4 * h)).astype(np.float32)
            bias = np.zeros(4 * h, np.float32)
            bias[h : 2 * h] = 1
            self.w["c" + d] = bias
        self.w["o"] = r.normal(0, 0.2, (2 * h, 1)).astype(np.float32)
        self.w["ob"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """x: (steps, pages, SIZE). Outputs of each step, and what the backward pass needs."""
        h = self.w["h" + d].shape[0]
        pre = x @ self.w["x" + d] + self.w["c" + d]
        state = np.zeros((x.shape[1], h), np.float32)
        cell = state.copy()
        out, trace = np.zeros((*x.shape[:2], h), np.float32), []
        steps = range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1)
        for t in steps:
            z = pre[t] + state @ self.w["h" + d]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            new = f * cell + i * g
            th = np.tanh(new)
            if keep:
                trace.append((t, i, f, o, g, th, cell, state, m))
            cell = np.where(m, new, cell)
            state = np.where(m, o * th, state)
            out[t] = state
        return out, trace

    def forward(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits (steps, pages)."""
        both = [self._run(x, mask, d, False)[0] for d in ("f", "b")]
        return (np.concatenate(both, axis=2) @ self.w["o"])[:, :, 0] + self.w["ob"]

    def step(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients of a batch."""
        (of, tf), (ob, tb) = (self._run(x, mask, d, True) for d in ("f", "b"))
        both = np.concatenate([of, ob], axis=2)
        p = _sigmoid((both @ self.w["o"])[:, :, 0] + self.w["ob"])
        n = max(1, mask.sum())
        loss = -float((mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / n)
        d_out = ((p - y) * mask / n).astype(np.float32)
        grads = {"o": np.tensordot(both, d_out, ((0, 1), (0, 1)))[:, None], "ob": np.array([d_out.sum()], np.float32)}
        d_both = d_out[:, :, None] * self.w["o"][:, 0]
        h = of.shape[2]
        for d, trace, part in (("f", tf, d_both[:, :, :h]), ("b", tb, d_both[:, :, h:])):
            wh = self.w["h" + d]
            dz_all, gh = np.zeros((*x.shape[:2], 4 * h), np.float32), np.zeros_like(wh)
            ds, dc = np.zeros((x.shape[1], h), np.float32), np.zeros((x.shape[1], h), np.float32)
            for t, i, f, o, g, th, cell, state, m in reversed(trace):
                ds = ds + part[t]
                do = ds * th
                dn = dc + ds * o * (1 - th**2)
                dz = np.concatenate([dn * g * i * (1 - i), dn * cell * f * (1 - f), do * o * (1 - o), dn * i * (1 - g**2)], axis=1) * m
                gh += state.T @ dz
                dz_all[t] = dz
                ds = np.where(m, dz @ wh.T, ds)
                dc = np.where(m, dn * f, dc)
            grads["x" + d] = np.tensordot(x, dz_all, ((0, 1), (0, 1)))
            grads["h" + d], grads["c" + d] = gh, dz_all.sum(axis=(0, 1))
        return loss, grads

    def label(self, x: np.ndarray, first: np.ndarray, cells: int = 1 << 14) -> np.ndarray:
        """Probability that each block is main text; pages of like length go together."""
        n, out = np.diff(first), np.zeros(len(x), np.float32)
        order = np.argsort(n, kind="stable")
        order = order[n[order] > 0]
        i = 0
        while i < len(order):
            j = i + 1
            while j < len(order) and n[order[j]] * (j + 1 - i) <= cells:
                j += 1
            own = order[i:j]
            batch, mask = pad(x, first, own)
            p = _sigmoid(self.forward(batch, mask))
            for k, r in enumerate(own.tolist()):
                out[first[r] : first[r + 1]] = p[: n[r], k]
            i = j
        return out


def pad(x: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(first)[rows]
    batch, mask = np.zeros((int(n.max()), len(rows), x.shape[1]), np.float32), np.zeros((int(n.max()), len(rows)), bool)
    for k, r in enumerate(rows.tolist()):
        batch[: n[k], k] = x[first[r] : first[r + 1]]
        mask[: n[k], k] = True
    return batch, mask


def generated(pages: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, page starts and labels of generated pages; those whose blocks don't match are left out."""
    maker, found, labels = PageMaker(seed), [], []
    for _ in range(pages):
        page, marks = maker.page()
        own = blocks(page)
        if len(own) == len(marks):
            found.append(own)
            labels += marks
    x, first = vectors(found)
    return x, first, np.array(labels, np.float32)


def train(pages: int = PAGES, epochs: int = EPOCHS, seed: int = SEED, rate: float = 0.012) -> Network:
    """A network fitted by Adam to generated pages; the same at each call."""
    x, first, y = generated(pages, seed)
    net, r = Network(seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(w) for k, w in net.w.items()} for _ in range(2))
    t = 0
    n = np.diff(first)
    for epoch in range(epochs):
        order = np.argsort(n + r.uniform(0, 6, len(n)))
        groups = [order[i : i + 24] for i in range(0, len(order), 24)]
        r.shuffle(groups)
        lr = rate * (1 - epoch / epochs) ** 0.5
        for rows in groups:
            batch, mask = pad(x, first, rows)
            # Some names of paths, and the words of half the pages, are hidden at random, so that no single sign is relied on.
            batch[:, :, :PATH] *= r.random((1, len(rows), PATH)) > 0.06
            batch[:, :, PATH : PATH + WORDS] *= r.random((1, len(rows), 1)) > 0.5
            target = pad(y[:, None], first, rows)[0][:, :, 0]
            _, grads = net.step(batch, mask, target)
            t += 1
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            for k, g in grads.items():
                g = g * min(1.0, 2.0 / (norm + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                net.w[k] = (net.w[k] - lr * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return net


_trained: dict[tuple, Network] = {}


def network() -> Network:
    """The trained network, once per driver process."""
    key = (PAGES, EPOCHS, SEED)
    if key not in _trained:
        _trained[key] = train()
    return _trained[key]


#: Tags of a paragraph, and of what may stand around it on a page of nothing else.
PARAGRAPHS, AROUND = frozenset("p pre blockquote article main".split()), frozenset("html body div main article section p pre blockquote".split())
_TELLING = frozenset(f".{w}" for kind, words in NAMES.items() if kind not in ("main", "plain") for w in words.split())


def alone(block: tuple[tuple, str, int]) -> bool:
    """Whether the only block of a page is its text: with nothing around it there is nothing to tell it from, so a paragraph without links and telling names counts."""
    path, _, linked = block
    tags = [e[0] for e in path]
    return not linked and bool(tags) and tags[-1] in PARAGRAPHS and AROUND.issuperset(tags) and not any(_TELLING.intersection(e[1:]) for e in path)


def texts_of(pages: list[str | None], net: Network) -> list[str]:
    """Main text of each page."""
    found = [blocks(p) if p else [] for p in pages]
    x, first = vectors(found)
    keep = net.label(x, first) >= 0.5
    for r, own in enumerate(found):
        if len(own) == 1 and alone(own[0]):
            keep[first[r]] = True
    return ["\n".join(b[1] for b, k in zip(own, keep[first[r] : first[r + 1]].tolist(), strict=True) if k) for r, own in enumerate(found)]


def extract(pages: DataFrame, net: Network | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of ``pages``."""
    shared = pages.sparkSession.sparkContext.broadcast((net or network()).w)
    own: list[Network] = []

    def each(batch):
        if not own:
            own.append(Network())
            own[0].w = shared.value
        for i, j in bs.slices(bs.column(batch.column(2))[1]):
            done = texts_of(batch.column(2).slice(i, j - i).to_pylist(), own[0])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(done, pa.string()), pa.array([len(t) for t in done], pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return mapped(pages.select("page_id", "url", "html"), each, f"page_id {kind}, url string, text string, n_chars bigint")
