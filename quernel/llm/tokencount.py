"""Token counts by rank-synchronous merging of ragged symbol arrays.

The model is a sentencepiece BPE model with byte fallback: a text gets one
leading space, spaces become U+2581, and neighbouring symbols whose
concatenation is a piece merge in order of score, leftmost first.  No piece has
U+2581 after another character, so runs of spaces with the word behind them are
independent pre-tokens.  Distinct pre-tokens of a batch are held as one ragged
array of symbols.  In each round every pre-token merges all pairs of its own
lowest rank that don't overlap, from the left; of a piece that could take part in
a pair of no higher rank than its own, only the leftmost, since merging that one
may come before the rest.  Rounds end when none has a pair left.  The symbols
that survive are counted: one token for a piece, one for each UTF-8 byte of a
character that is no piece.

Words of any language end within ``ROUNDS`` rounds.  What is left then, such as a
megabyte without a space, has merges that wait for each other one by one; its
symbols finish in the same order through a heap of pairs, in time n log n.

Defined results: null and empty texts have 0 tokens; special strings in a text
are plain characters; texts and words may have any length; doc_id may have any
type and be null; rows that repeat stay; an empty table gives none; other columns
are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .store import mapped

ROUNDS, CACHE = 64, 1 << 20
SPACE = "▁"
NONE = np.int64(1 << 62)


class Merger:
    """Pieces and merges of one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = {i: model.id_to_piece(i) for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))}
        if any(SPACE in p.lstrip(SPACE) for p in pieces.values()):
            raise ValueError("pieces that join words aren't supported")
        self.ids = {p: i for i, p in pieces.items()}
        levels = {s: r for r, s in enumerate(sorted({model.get_score(i) for i in pieces}, reverse=True))}
        ranks = {i: levels[model.get_score(i)] for i in pieces}
        self.size = n
        pairs = []
        for i, p in pieces.items():
            for cut in range(1, len(p)):
                left, right = self.ids.get(p[:cut]), self.ids.get(p[cut:])
                if left is not None and right is not None:
                    pairs.append((left * n + right, ranks[i], i))
        self._also_unknown(pieces)
        pairs.sort()
        self.keys, self.ranks, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        own = np.full(n, NONE)
        own[self.made] = self.ranks
        self.table = {k: (r, m) for k, r, m in pairs}
        self.early = np.zeros(n, bool)
        for side in (self.keys // n, self.keys % n):
            part = (own[side] < NONE) & (self.ranks <= own[side])
            self.early[side[part]] = True
        self.reset()

    def _also_unknown(self, pieces: dict[int, str]) -> None:
        single = {p for p in pieces.values() if len(p) == 1}
        for p in pieces.values():
            if not set(p) <= single:
                raise ValueError("a piece has a character that is no piece")

    def reset(self) -> None:
        self.known, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def symbols(self, text: str) -> list[int]:
        """Piece ids of the characters; -k for a character of k bytes that is no piece."""
        get = self.ids.get
        return [s if (s := get(c)) is not None else -len(c.encode()) for c in text]

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        rows = [self.symbols(t) for t in texts]
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        flat = np.fromiter((s for r in rows for s in r), np.int64, int(sizes.sum()))
        return self._merged(flat, sizes)

    def lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made piece of each pair; NONE where they don't merge."""
        key = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.made[at]

    def _chosen(self, at: np.ndarray, after: np.ndarray, seq: np.ndarray, made: np.ndarray) -> np.ndarray:
        """Of places of lowest rank (each with the next symbol, its sequence and the piece it makes), those to merge now."""
        change = np.ones(len(at), bool)
        change[1:] = after[:-1] != at[1:]
        run = np.maximum.accumulate(np.where(change, np.arange(len(at)), 0))
        take = (np.arange(len(at)) - run) % 2 == 0  # of a row of overlapping pairs, every other one
        first = np.ones(len(at), bool)
        first[1:] = seq[1:] != seq[:-1]
        wait = np.repeat(self.early[made[first]], np.diff(np.append(np.flatnonzero(first), len(at))))
        return np.flatnonzero(np.where(wait, first, take))

    def _merged(self, sym: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        total = np.zeros(len(sizes), np.int64)
        seq = np.repeat(np.arange(len(sizes)), sizes)
        rank, made = np.full(len(sym), NONE), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            same = seq[1:] == seq[:-1]
            r, m = self.lookup(sym[:-1], sym[1:])
            rank[:-1], made[:-1] = np.where(same, r, NONE), m
        for _ in range(ROUNDS):
            if not len(sym):
                return total
            first = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            best = np.minimum.reduceat(rank, first)
            length = np.diff(np.append(first, len(sym)))
            over = best == NONE
            if over.any():
                done = np.repeat(over, length)
                np.add.at(total, seq[done], np.where(sym[done] < 0, -sym[done], 1))
                keep = ~done
                sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
                if not len(sym):
                    return total
                best, length = best[~over], length[~over]
            at = np.flatnonzero(rank == np.repeat(best, length))
            at = at[self._chosen(at, at + 1, seq[at], made[at])]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            sym, seq, rank, made = sym[keep], seq[keep], rank[keep], made[keep]
            at = moved[at]
            for place in (at, at[at > 0] - 1):
                right = np.minimum(place + 1, len(sym) - 1)
                r, m = self.lookup(sym[place], sym[right])
                rank[place] = np.where((right > place) & (seq[place] == seq[right]), r, NONE)
                made[place] = m
        for part in np.split(np.arange(len(sym)), np.flatnonzero(seq[1:] != seq[:-1]) + 1):
            if len(part):
                total[seq[part[0]]] += self._finish(sym[part].tolist())
        return total

    def _finish(self, sym: list[int]) -> int:
        """Tokens of one sequence, by single merges in order of rank and place."""
        n, size, table = len(sym), self.size, self.table
        after, before, heap = [*range(1, n), -1], [-1, *range(n - 1)], []

        def offer(i: int) -> None:
            j = after[i]
            if j >= 0 and sym[i] >= 0 and sym[j] >= 0 and (hit := table.get(sym[i] * size + sym[j])):
                heapq.heappush(heap, (hit[0], i, sym[i], sym[j], hit[1]))

        for i in range(n):
            offer(i)
        gone = bytearray(n)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j < 0 or sym[i] != a or sym[j] != b:
                continue
            sym[i], gone[j], after[i] = made, 1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return sum(1 if s >= 0 else -s for s, g in zip(sym, gone, strict=True) if not g)

    def totals(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """Tokens of each text; texts have their leading space and single-byte spaces."""
        space = data == 0x20
        cut = space.copy()
        cut[1:] &= ~space[:-1]
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        if not len(starts):
            return np.zeros(len(offs) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        keys = bs.hashes(data, starts, ends, np.arange(256, dtype=np.uint8))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        there = at < len(self.known)
        new[there] = self.known[at[there]] != distinct[there]
        if new.any():
            if len(self.known) + new.sum() > CACHE:
                self.reset()
                new[:] = True
            raw = data.tobytes()
            texts = [raw[a:b].decode().replace(" ", SPACE) for a, b in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)]
            known = np.concatenate([self.known, distinct[new]])
            counts = np.concatenate([self.counts, *[self.count(texts[k : k + 20000]) for k in range(0, len(texts), 20000)]])
            order = np.argsort(known, kind="stable")
            self.known, self.counts = known[order], counts[order]
        per = self.counts[np.searchsorted(self.known, distinct)][back]
        return np.diff(np.concatenate([[0], np.cumsum(per)])[np.searchsorted(starts, offs)])


_mergers: dict[str, Merger] = {}


def merger(path: str) -> Merger:
    """One per worker process."""
    if path not in _mergers:
        _mergers[path] = Merger(path)
    return _mergers[path]


def count_tokens(docs: DataFrame, model: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def each(batch):
        own = merger(model)
        for k, m in bs.slices(bs.column(batch.column(1))[1]):
            texts = pc.fill_null(batch.column(1).slice(k, m - k), "")
            size = pc.binary_length(texts).cast(pa.int64())
            plain = pc.replace_substring(texts, SPACE, " ")
            led = pc.if_else(pc.equal(size, 0), "", pc.binary_join_element_wise(" ", plain, ""))
            n = own.totals(*bs.column(led))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, m - k), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return mapped(docs.select("doc_id", F.col("text")), each, f"doc_id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
