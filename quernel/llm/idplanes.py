"""Token ids of documents in plane-shuffled blocks, and their reader.

Documents are dealt out by ranges of doc_id and sorted; each task packs whole
documents into segments.  A segment is one binary value in the format below,
kept in a Parquet table of a shared folder so that Spark commits it and any
store will do.  The stream of ids of a segment is cut into blocks of
``BLOCK`` ids; a block of little-endian 32-bit ids is turned into byte planes
(all lowest bytes, then all second bytes, ...) or bit planes, each compressed by
zstandard on its own; all-zero planes take no bytes.

    b"QPLN" | version u8 | planes u8 (4 or 32) | block size u32 | documents u32 | ids u64
    for each document: ids u32
    chunk index, for each block: offset u64 | ids u32 | length u32 of each plane
    planes, in order

All numbers are little-endian.  A segment closes at ``SEGMENT`` ids, so only a
single longer document makes a longer one.

Encoding splits texts at single spaces between characters that aren't white space:
the pre-tokenizer always cuts there, so each distinct piece needs the library
once per task, and repeated pieces come from a bounded cache.

Defined results: null and empty texts are the end id alone; documents without
doc_id come first, equal doc_ids are in order of a hash of their texts; rows
that repeat stay; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytescan as bs
from .store import mapped, ship, stash, trim

BLOCK, SEGMENT, CACHE, TOGETHER, END = 1 << 16, 1 << 20, 1 << 19, 64, 0
_HEAD = struct.Struct("<4sBBIIQ")


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    """Byte planes (4) or bit planes (32) of 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4).T
    if planes == 4:
        return [np.ascontiguousarray(p).tobytes() for p in raw]
    bits = np.unpackbits(np.ascontiguousarray(raw)[:, :, None], axis=2, bitorder="little")
    return [np.packbits(bits[k // 8, :, k % 8], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    if len(parts) == 4:
        raw = np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)
        return np.ascontiguousarray(raw).view("<u4").ravel()
    out = np.zeros(n, np.uint32)
    for k, p in enumerate(parts):
        out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype(np.uint32) << np.uint32(k)
    return out


def pack(ids: np.ndarray, counts: np.ndarray, planes: int = 4, block: int = BLOCK, level: int = 3) -> bytes:
    """One segment."""
    packer, index, body, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for i in range(0, len(ids), block):
        part = ids[i : i + block]
        raw = to_planes(part, planes)
        done = [packer.compress(p) if any(p) else b"" for p in raw]
        index.append(struct.pack(f"<QI{planes}I", at, len(part), *map(len, done)))
        at += sum(map(len, done))
        body += done
    head = _HEAD.pack(b"QPLN", 1, planes, block, len(counts), len(ids))
    return b"".join([head, np.ascontiguousarray(counts, "<u4").tobytes(), *index, *body])


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts by document of a segment."""
    magic, version, planes, block, docs, total = _HEAD.unpack_from(data)
    if magic != b"QPLN" or version != 1:
        raise ValueError("not a segment of token ids")
    at = _HEAD.size
    counts = np.frombuffer(data, "<u4", docs, at)
    at += 4 * docs
    entry = struct.Struct(f"<QI{planes}I")
    blocks = -(-total // block)
    body, reader, out = at + entry.size * blocks, zstandard.ZstdDecompressor(), []
    for k in range(blocks):
        offset, n, *sizes = entry.unpack_from(data, at + k * entry.size)
        offset, parts = offset + body, []
        plain = n if planes == 4 else -(-n // 8)
        for size in sizes:
            parts.append(reader.decompress(data[offset : offset + size], max_output_size=plain) if size else bytes(plain))
            offset += size
        out.append(from_planes(parts, n))
    return np.concatenate(out) if out else np.zeros(0, np.uint32), counts


def unpack_range(data: bytes, first: int, n: int) -> np.ndarray:
    """Ids first .. first + n of a segment; only the blocks that hold them are read, by the chunk index."""
    _, _, planes, block, docs, total = _HEAD.unpack_from(data)
    entry = struct.Struct(f"<QI{planes}I")
    index = _HEAD.size + 4 * docs
    body, reader, out = index + entry.size * -(-total // block), zstandard.ZstdDecompressor(), [np.zeros(0, np.uint32)]
    for k in range(first // block, -(-(first + n) // block) if n else 0):
        at, m, *sizes = entry.unpack_from(data, index + k * entry.size)
        at, plain, parts = at + body, m if planes == 4 else -(-m // 8), []
        for size in sizes:
            parts.append(reader.decompress(data[at : at + size], max_output_size=plain) if size else bytes(plain))
            at += size
        ids = from_planes(parts, m)
        out.append(ids[max(0, first - k * block) : first + n - k * block])
    return np.concatenate(out)


def picked(data: bytes, names: list, wanted: set) -> list[tuple[object, np.ndarray]]:
    """(name, ids) of those documents of a segment that are wanted."""
    counts = np.frombuffer(data, "<u4", len(names), _HEAD.size).astype(np.int64)
    starts = np.cumsum(counts) - counts
    return [(x, unpack_range(data, int(starts[k]), int(counts[k]))) for k, x in enumerate(names) if x in wanted]


class Encoder:
    """Ids of texts as the tokenizers library gives them, with a cache by piece."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocabulary = self.library.get_vocab()
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # the sign for a leading space
        self.reset()

    def reset(self) -> None:
        self.known = np.zeros(0, np.uint64)
        self.where = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @staticmethod
    def solid(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes that end, and bytes that begin, a character which surely isn't white space."""
        plain = (data > 0x20) & (data < 0x7F)
        two = (data >= 0xC3) & (data <= 0xDF)
        ends = plain.copy()
        ends[1:] |= two[:-1] & (data[1:] >= 0x80)
        return ends, plain | two | (data >= 0xE4)

    def pieces(self, data: np.ndarray, offs: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Starts of pieces: texts, and single spaces between characters that aren't white space."""
        cut = np.zeros(len(data), bool)
        if len(data) > 2:
            cut[1:-1] = (data[1:-1] == 0x20) & ends[:-2] & begins[2:]
        cut[offs[:-1][offs[:-1] < len(data)]] = True
        return np.flatnonzero(cut)

    def _of_pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, closes: np.ndarray, opens: np.ndarray, together: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and how many each has.

        Pieces of one space and then none, with no other white space behind the
        space or at the end, are encoded many at a time: joined, they are cut
        alike, and just the first token of each starts with a space.  Should a
        tokenizer cut them otherwise, each piece is encoded by itself.
        """
        blank = np.concatenate([[0], np.cumsum(data == 0x20)])
        size = ends - starts
        joins = together & (size > 1) & (data[starts] == 0x20) & (blank[ends] - blank[starts] == 1) & closes[ends - 1]
        joins[joins] = opens[starts[joins] + 1]
        order = np.concatenate([np.flatnonzero(joins), np.flatnonzero(~joins)])
        many = int(joins.sum())
        s, n = starts[order], size[order]
        stop = np.cumsum(n)
        raw = data[np.repeat(s - (stop - n), n) + np.arange(int(stop[-1]))].tobytes()
        cuts = np.concatenate([[0], stop[min(TOGETHER, many) - 1 : many : TOGETHER], stop[many - 1 : many], stop[many:]]) if many else np.concatenate([[0], stop])
        cuts = np.unique(cuts).tolist()
        texts = [raw[a:b].decode() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        found = []
        for k in range(0, len(texts), 1024):
            found += [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts[k : k + 1024], add_special_tokens=False)]
        flat = np.concatenate(found)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        groups = -(-many // TOGETHER)
        head = int(lengths[:groups].sum())
        begins = np.flatnonzero(self.spaced[flat[:head]])
        if len(begins) != many:
            return self._of_pieces(data, starts, ends, closes, opens, together=False)
        sizes = np.concatenate([np.diff(np.append(begins, head)), lengths[groups:]]) if many else lengths
        back = np.argsort(order)
        at = np.cumsum(sizes) - sizes
        out = sizes[back]
        done = np.cumsum(out)
        return flat[np.repeat(at[back] - (done - out), out) + np.arange(int(done[-1]))], out

    def encode(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and how many each has."""
        closes, opens = self.solid(data)
        starts = self.pieces(data, offs, closes, opens)
        ends = np.append(starts[1:], len(data))
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offs) - 1, np.int64)
        keys = bs.hashes(data, starts, ends, np.arange(256, dtype=np.uint8))
        distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        new = np.ones(len(distinct), bool)
        new[at < len(self.known)] = self.known[at[at < len(self.known)]] != distinct[at < len(self.known)]
        if new.any():
            if len(self.known) + new.sum() > CACHE:
                self.reset()
                new[:] = True
            flat, sizes = self._of_pieces(data, starts[first[new]], ends[first[new]], closes, opens)
            where = len(self.ids) + np.cumsum(sizes) - sizes
            known = np.concatenate([self.known, distinct[new]])
            order = np.argsort(known, kind="stable")
            self.known = known[order]
            self.where = np.concatenate([self.where, where])[order]
            self.sizes = np.concatenate([self.sizes, sizes])[order]
            self.ids = np.concatenate([self.ids, flat])
        at = np.searchsorted(self.known, distinct)[back]
        sizes = self.sizes[at]
        ends_at = np.cumsum(sizes)
        take = np.repeat(self.where[at] - (ends_at - sizes), sizes) + np.arange(int(ends_at[-1]))
        per = np.concatenate([[0], ends_at])[np.searchsorted(starts, offs)]
        return self.ids[take], np.diff(per)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def write(docs: DataFrame, tokenizer: str, planes: int = 4) -> DataFrame:
    """Encode and store; the table of segments (part, seq, ids, doc_ids, payload) in ascending order of (part, seq)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))

    def run(batches):
        part, seq, held, names, size = TaskContext.get().partitionId(), 0, [], [], 0

        def close():
            counts = np.concatenate([c for _, c in held])
            payload = pack(np.concatenate([i for i, _ in held]), counts, planes)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(counts.sum())]), pa.array([[x for n in names for x in n]], pa.list_(kind_arrow)), pa.array([payload], pa.binary())], ["part", "seq", "ids", "doc_ids", "payload"])

        kind_arrow = None
        own = encoder(tokenizer)
        for batch in batches:
            kind_arrow = batch.column(0).type
            data, offs = bs.column(batch.column(1))
            for i, j in bs.slices(offs):
                ids, counts = own.encode(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                ids = np.insert(ids, np.cumsum(counts), END).astype(np.uint32)
                held.append((ids, counts + 1))
                names.append(batch.column(0).slice(i, j - i).to_pylist())
                size += len(ids)
                if size >= SEGMENT:
                    yield close()
                    seq, held, names, size = seq + 1, [], [], 0
        if held:
            yield close()
        trim()

    ship(docs.sparkSession)
    return stash(ordered.mapInArrow(run, f"part int, seq int, ids bigint, doc_ids array<{kind}>, payload binary"), "segments")


def starts(segments: DataFrame) -> DataFrame:
    """(part, seq, base): ids before each segment, from sums by part and then within parts."""
    each = segments.select("part", "seq", "ids")
    parts = each.groupBy("part").agg(F.sum("ids").alias("ids"))
    ahead = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("ids").over(ahead.orderBy("part")), F.lit(0)).alias("before"))
    own = F.coalesce(F.sum("ids").over(ahead.partitionBy("part").orderBy("seq")), F.lit(0))
    return each.withColumn("own", own).join(parts, F.col("part") == F.col("p")).select("part", "seq", (F.col("before") + F.col("own")).alias("base"))


def read(segments: DataFrame) -> DataFrame:
    """(part, seq, doc_id, start in the segment, n_tokens, ids_crc32) of each document in the stored segments."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()

    def each(batch):
        for r in range(batch.num_rows):
            ids, counts = unpack(batch.column(3)[r].as_buffer().to_pybytes())
            stop = np.cumsum(counts.astype(np.int64))
            raw = memoryview(np.ascontiguousarray(ids, "<u4").view(np.uint8))
            crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stop.tolist(), counts.tolist(), strict=True)]
            m = len(counts)
            names = batch.column(2).slice(r, 1).flatten()
            yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[r], m), pa.repeat(batch.column(1)[r], m), names, pa.array(stop - counts), pa.array(counts.astype(np.int64)), pa.array(np.array(crc, np.int64))], ["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = segments.select("part", "seq", "doc_ids", "payload")
    return mapped(rows, each, f"part int, seq int, doc_id {kind}, at bigint, n_tokens bigint, ids_crc32 bigint")


def documents_of(segments: DataFrame, doc_ids: list) -> DataFrame:
    """(doc_id, ids) of some documents, from the blocks that hold them."""
    kind = segments.schema["doc_ids"].dataType.elementType.simpleString()
    wanted = set(doc_ids)

    def each(batch):
        for r in range(batch.num_rows):
            found = picked(batch.column(1)[r].as_buffer().to_pybytes(), batch.column(0)[r].as_py(), wanted)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], batch.column(0).type.value_type), pa.array([i.tolist() for _, i in found], pa.list_(pa.int64()))], ["doc_id", "ids"])

    some = F.arrays_overlap("doc_ids", F.array(*[F.lit(x) for x in doc_ids]).cast(segments.schema["doc_ids"].dataType))
    return mapped(segments.filter(some).select("doc_ids", "payload"), each, f"doc_id {kind}, ids array<bigint>")


def write_and_read(docs: DataFrame, tokenizer: str, planes: int = 4) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, as read back from the stored segments."""
    segments = write(docs, tokenizer, planes)
    return read(segments).join(starts(segments), ["part", "seq"]).select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
