"""N-gram Jaccard join by universe partitions and the pigeonhole principle.

A document is the set of its distinct ``SHINGLE``-word shingles.  At a threshold
of 90 % two sets of sizes x <= y <= x / 0.9 differ in at most (x + y) / 19
elements.  Sizes are cut into bands so that links stay within a band or reach
the next; every band k has a scheme, used by sets of band k and k + 1, with the
largest difference H of such a pair.  The scheme deals the universe of shingles
into segments by hash.  A segment may be indexed as it is (worth 1: it finds
pairs equal there) or with all its one-deletions (worth 2: pairs that differ by
one element there); if the worths add up to H + 1, every link shares a
signature.  Which segments get deletions is chosen for each scheme by cost:
signatures to make against pairs that chance would make from the corpus' number
of documents; short sets in a large corpus get deletions.

Sets that share a signature are compared by a sketch first: of 4 (H + 1)
sub-segments, a link leaves all but H equal, so four bits for each give an exact
bound.  Survivors are verified on their whole texts.  To report components
it isn't needed to verify every pair.  In a first round every set of a bucket
meets the one that is in most buckets, such as the text that others were edited
from, and of the partners that its sketch allows one is verified.  After that nearly
all buckets hold sets of one component only and are dropped.  The second round
compares all sets of different components in the buckets that are left.  Of a
bucket of up to ``LISTED`` sets the pairs themselves are told, which are the same in
the many buckets that two sets share, and get their sketches once; beyond that the
sketches go along and only near pairs are told.  There a bucket's largest component
needs no comparison within itself; all other sets meet each other and it in blocks
of about ``BLOCK`` sets, by as many tasks as there are pairs of blocks, so that
neither a task nor the rows grow with the square of a group of copies.  Both ways
tell the same pairs.  Joins with tables that grow with the corpus are merge joins at
every size, so that none becomes a broadcast where the corpus happens to be small.

Equal sets are one node, a 64-bit fingerprint whose collisions are detected with
a second one.  Defined results: a null or empty text has no words, 0 shingles
and is linked with nothing; rows that repeat or share an id are joined if their
texts are; rows without doc_id take part and get the component's smallest id
(null if it has none); other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytescan as bs
from .bits import bitmap, inside
from .components import components
from .store import mapped, ship, stash, trim

SHINGLE, LISTED, BLOCK, FINE, TOGETHER = 3, 32, 512, 4, 1 << 12
SEEN = 1 << 18
KEY = ("text_hash", "text_hash_2")
_U = np.uint64
_K1, _K2, _K3 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)


def text_key() -> list:
    """The columns of KEY: two hashes of a row's text."""
    return [F.xxhash64("text").alias(KEY[0]), F.xxhash64(F.lit(7), "text").alias(KEY[1])]


#: How many of a byte's two halves are not zero.
_HALVES = np.array([(b & 15 > 0) + (b >> 4 > 0) for b in range(256)], np.uint8)


class Plan:
    """Bands and, for each scheme, the largest difference, segments, and how many of these get deletions."""

    def __init__(self, documents: int, largest: int = 1 << 28):
        self.high, low = [], 1
        while low <= largest:
            self.high.append(max(low, 10 * low // 9))
            low = self.high[-1] + 1
        self.high = np.array(self.high, np.int64)
        self.most = (self.high + 10 * self.high // 9) // 19
        with_deletions = [self._allocate(int(h), int(n), documents) for h, n in zip(self.most, self.high, strict=True)]
        self.deleted = np.array(with_deletions, np.int64)
        self.segments = self.most + 1 - self.deleted

    @staticmethod
    def _allocate(most: int, size: int, documents: int) -> int:
        """Segments with deletions at the least cost; beyond some hundred elements chance makes no pairs."""

        def cost(z: int) -> float:
            m = most + 1 - z
            g = size / m
            chance = math.exp(-2 * g) * ((m - z) + z * (1 + 2 * g))
            return documents * ((m - z) + z * (1 + g)) + 2.0 * documents * documents * chance

        return min(range(min(most + 1, 64) // 2 + 1), key=cost) if most else 0

    def band(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.high, n)


def sets(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and the index of each text's first."""
    words, _, _, first = bs.scan(data, offs, bs.SPACED)
    h, who = bs.shingles(words, first, SHINGLE)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (who[1:] != who[:-1])
    h, who = h[keep], who[keep]
    return h, np.searchsorted(who, np.arange(len(offs)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    return total[first[1:]] - total[first[:-1]]


def nodes(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint and second fingerprint of each set."""
    n = np.diff(first).astype(_U)
    return bs.mix(_sums(bs.mix(h ^ _K1), first) + n), bs.mix(_sums(bs.mix(h ^ _K2), first) ^ (n * _K3))


def signatures(h: np.ndarray, first: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of all sets under their two schemes, and each one's set; the lowest bit is the scheme's parity."""
    n = np.diff(first)
    band, sigs, owners = plan.band(n), [], []
    for back in (0, 1):
        rows = np.flatnonzero((n > 0) & (band >= back))
        if not len(rows):
            continue
        scheme = band[rows] - back
        m, z = plan.segments[scheme], plan.deleted[scheme]
        base = np.cumsum(m) - m
        at = np.concatenate([np.arange(first[r], first[r + 1]) for r in rows])
        local = np.repeat(np.arange(len(rows)), n[rows])
        value = bs.mix(h[at] + scheme[local].astype(_U) * _K2)
        segment = (((h[at] >> _U(32)) * m[local].astype(_U)) >> _U(32)).astype(np.int64)
        slot = base[local] + segment
        total = np.zeros(int(m.sum()), _U)
        np.add.at(total, slot, value)
        owner = np.repeat(np.arange(len(rows)), m)
        place = np.arange(len(total)) - base[owner]
        parity = (scheme & 1).astype(_U)
        name = place.astype(_U) * _K1 + scheme[owner].astype(_U) * _K3
        sigs.append(bs.mix(total + name) & ~_U(1) | parity[owner])
        owners.append(rows[owner])
        less = np.flatnonzero(segment < z[local])
        if len(less):
            sigs.append(bs.mix(total[slot[less]] - value[less] + name[slot[less]]) & ~_U(1) | parity[local[less]])
            owners.append(rows[local[less]])
    if not sigs:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    sig, owner = np.concatenate(sigs), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return sig[order], owner[order]


def sketches(h: np.ndarray, first: np.ndarray, plan: Plan) -> tuple[list[bytes | None], list[bytes | None]]:
    """For each set the sketch under its scheme of even number and under that of odd number."""
    n = np.diff(first)
    band, out = plan.band(n), ([None] * len(n), [None] * len(n))
    other = bs.mix(h ^ _K3)
    for r in np.flatnonzero(n > 0).tolist():
        part = other[first[r] : first[r + 1]]
        for k in (band[r], band[r] - 1):
            if k >= 0:
                q = FINE * (int(plan.most[k]) + 1)
                total = np.zeros(q, _U)
                np.add.at(total, ((part >> _U(32)) * _U(q) >> _U(32)).astype(np.int64), bs.mix(part))
                half = (bs.mix(total) & _U(15)).astype(np.uint8)
                out[k & 1][r] = (half[0::2] | half[1::2] << 4).tobytes()
    return out


def shared(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Intersection size of the sets 2i and 2i + 1."""
    pair = np.repeat(np.arange(len(first) - 1) // 2, np.diff(first))
    order = np.lexsort((h, pair))
    h, pair = h[order], pair[order]
    same = (h[1:] == h[:-1]) & (pair[1:] == pair[:-1]) if len(h) > 1 else np.zeros(0, bool)
    return np.bincount(pair[1:][same] if len(h) > 1 else np.zeros(0, np.int64), minlength=(len(first) - 1) // 2)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _grouped(rows: DataFrame, keys: list[str], each, schema: str, order: tuple[str, ...] | list[str] = ("node",)) -> DataFrame:
    """Rows of equal keys, side by side and whole, through ``each(group: dict of arrays)``; groups have a bounded size."""
    ship(rows.sparkSession)

    def run(batches):
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if rest.num_rows == 0:
                rest = None
                continue
            cols = [rest.column(rest.schema.names.index(k)).to_numpy() for k in keys]
            change = np.zeros(rest.num_rows - 1, bool)
            for c in cols:
                change |= c[1:] != c[:-1]
            cuts = np.concatenate([[0], np.flatnonzero(change) + 1])
            if len(cuts) > 1:
                yield from each(rest, cuts)
            rest = rest.slice(int(cuts[-1]))
        if rest is not None and rest.num_rows:
            yield from each(rest, np.array([0, rest.num_rows]))
        trim()

    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)
    return dealt.mapInArrow(run, schema)


def _pairs_of(batch: pa.RecordBatch, cuts: np.ndarray):
    """All pairs of nodes of different roots in each group."""
    node, root = (batch.column(batch.schema.names.index(k)).to_numpy() for k in ("node", "root"))
    low, high = [], []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        i, j = np.triu_indices(b - a, 1)
        apart = root[a + i] != root[a + j]
        low.append(node[a + i[apart]])
        high.append(node[a + j[apart]])
    lo, hi = np.concatenate(low), np.concatenate(high)
    if len(lo):
        pair = np.unique(np.stack([np.minimum(lo, hi), np.maximum(lo, hi)], axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"])


class Join:
    """One run: its tables are written once and read by the rounds."""

    def __init__(self, docs: DataFrame, keyed: bool = False):
        """``keyed``: ``rows`` also has the text hash of each row, in KEY."""
        self.docs = docs.select("doc_id", "text", *(text_key() if keyed else []))
        self.key = list(KEY) if keyed else []
        self.plan = Plan(docs.count())
        self.kind = docs.schema["doc_id"].dataType.simpleString()
        self.index()

    def index(self) -> None:
        """``rows`` (doc_id, n, node, check) for each document, ``classes``, and ``buckets`` (sig, node) of shared signatures."""
        plan, seen, key = self.plan, set(), self.key

        def each(batch):
            data, offs = bs.column(batch.column(1))
            for i, j in bs.slices(offs):
                h, first = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                node, check = nodes(h, first)
                n = np.diff(first)
                sig, owner = signatures(h, first, plan)
                fresh = np.zeros(j - i, bool)
                for r, x in enumerate(node.tolist()):
                    if x not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(x)
                        fresh[r] = True
                use = fresh[owner]
                sig, owner = sig[use], owner[use]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(owner, np.arange(j - i + 1)).astype(np.int32)), _signed(sig))
                keys = [batch.column(2 + k).slice(i, j - i) for k in range(len(key))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int64)), _signed(node), _signed(check), lists, *keys], ["doc_id", "n", "node", "check", "sigs", *key])

        kinds = "".join(f", {k} bigint" for k in key)
        self.rows = stash(mapped(self.docs, each, f"doc_id {self.kind}, n bigint, node bigint, check bigint, sigs array<bigint>{kinds}"), "rows")
        classes = self.rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("least_id"), F.min("check").alias("c1"), F.max("check").alias("c2"))
        self.classes = stash(classes, "classes")
        if self.classes.filter("c1 <> c2").limit(1).count():
            raise ValueError("two different sets have the same fingerprint")
        sigs = self.rows.select(F.explode("sigs").alias("sig"), "node")
        # A count would not tell copies from other sets.
        common = stash(sigs.groupBy("sig").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a <> b").select("sig"), "common")
        self.buckets = stash(sigs.join(common, "sig").distinct(), "buckets")

    def texts(self) -> None:
        """``held`` (node, n, even, odd, body): sketches and compressed text of each node in a bucket."""
        plan, bits = self.plan, self.docs.sparkSession.sparkContext.broadcast(bitmap(self.buckets, "node"))
        seen = set()

        def each(batch):
            import pyarrow.compute as pc

            data, offs = bs.column(batch.column(0))
            packer = zstandard.ZstdCompressor(level=1)
            for i, j in bs.slices(offs):
                h, first = sets(data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
                node, _ = nodes(h, first)
                use = inside(node, *bits.value) & (np.diff(first) > 0)
                pick = []
                for r in np.flatnonzero(use).tolist():
                    x = int(node[r])
                    if x not in seen:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(x)
                        pick.append(r)
                if not pick:
                    continue
                at = np.concatenate([np.arange(first[r], first[r + 1]) for r in pick])
                n = np.diff(first)[pick]
                even, odd = sketches(h[at], np.concatenate([[0], np.cumsum(n)]), plan)
                bodies = [packer.compress(t.encode()) for t in pc.take(batch.column(0), pa.array([i + r for r in pick])).to_pylist()]
                yield pa.RecordBatch.from_arrays([_signed(node[pick]), pa.array(n.astype(np.int64)), pa.array(even, pa.binary()), pa.array(odd, pa.binary()), pa.array(bodies, pa.binary())], ["node", "n", "even", "odd", "body"])

        found = mapped(self.docs.select("text"), each, "node bigint, n bigint, even binary, odd binary, body binary")
        used = self.buckets.select("node").distinct()
        self.held = stash(found.join(used, "node", "left_semi").dropDuplicates(["node"]), "held")

    def near(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sizes and sketches allow a link."""
        plan = self.plan
        side = self.held.select("node", "n", "even", "odd")
        met = pairs.join(side.toDF("a", "na", "ea", "oa").hint("merge"), "a").join(side.toDF("b", "nb", "eb", "ob").hint("merge"), "b")
        met = met.filter(F.least("na", "nb") * 10 >= F.greatest("na", "nb") * 9)

        def each(batch):
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            scheme = plan.band(np.minimum(cols["na"].to_numpy(), cols["nb"].to_numpy()))
            keep = np.zeros(batch.num_rows, bool)
            left, right = ((cols["ea"], cols["eb"]), (cols["oa"], cols["ob"]))
            for r, k in enumerate(scheme.tolist()):
                x, y = (left if k % 2 == 0 else right)
                x, y = (np.frombuffer(v[r].as_buffer(), np.uint8) for v in (x, y))
                keep[r] = len(x) == len(y) and int(_HALVES[x ^ y].sum()) <= plan.most[k]
            at = pa.array(np.flatnonzero(keep))
            return pa.RecordBatch.from_arrays([cols["a"].take(at), cols["b"].take(at)], ["a", "b"])

        return mapped(met, each, "a bigint, b bigint")

    def star_pairs(self) -> DataFrame:
        """For each set one near partner, of those that are in more buckets than all others of some bucket."""
        degree = self.buckets.groupBy("node").agg(F.count("*").alias("degree"))
        ranked = self.buckets.join(degree.hint("merge"), "node").repartition("sig")  # one exchange for both uses
        centre = ranked.groupBy("sig").agg(F.max(F.struct("degree", "node")).alias("c"))
        met = ranked.join(centre.hint("merge"), "sig").filter("node <> c.node").select(F.col("c.node").alias("a"), F.col("node").alias("b")).distinct()
        near = self.near(met).join(degree.toDF("a", "degree").hint("merge"), "a")
        return near.groupBy("b").agg(F.max(F.struct("degree", "a")).alias("c")).select("c.a", "b")

    def rest_pairs(self, root: DataFrame) -> DataFrame:
        """Every near pair of sets of different components that share a bucket.

        A bucket holds sets of bands k and k + 1; pairs of two sets of band k + 1
        belong to the other scheme, under which they share a signature too.
        """
        plan = self.plan
        rooted = self.buckets.join(root.hint("merge"), "node", "left").select("sig", "node", F.coalesce("root", "node").alias("root")).repartition("sig")
        several = rooted.groupBy("sig").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).filter("r1 <> r2").select("sig")
        self.open = stash(rooted.join(several.hint("merge"), "sig"), "open")
        each_root = self.open.groupBy("sig", "root").agg(F.count("*").alias("c"))
        shape = each_root.groupBy("sig").agg(F.max(F.struct("c", "root")).alias("top"), F.sum("c").alias("c"))
        one = F.col("c") <= BLOCK
        others, most = F.ceil((F.col("c") - F.col("top.c")) / BLOCK).cast("int"), F.ceil(F.col("top.c") / BLOCK).cast("int")
        few = self.open.join(shape.filter(F.col("c") <= LISTED).select("sig").hint("merge"), "sig")
        listed = self.near(_grouped(few, ["sig"], _pairs_of, "a bigint, b bigint").distinct())
        shape = shape.filter(F.col("c") > LISTED).select("sig", F.col("top.root").alias("top"), F.when(one, 1).otherwise(others).alias("others"), F.when(one, 0).otherwise(most).alias("most"))
        many = self.open.join(shape, "sig")
        within = (F.col("root") == F.col("top")) & (F.col("most") > 0)
        block = F.when(within, F.col("others") + F.pmod(F.xxhash64("node"), F.greatest("most", F.lit(1)))).otherwise(F.pmod(F.xxhash64("node"), F.col("others"))).cast("int")
        reach = F.when(within, F.col("others")).otherwise(F.col("others") + F.col("most"))
        many = many.withColumn("own", block).withColumn("x", F.explode(F.sequence(F.lit(0), reach - 1)))
        many = many.select("sig", F.least("own", "x").alias("p"), F.greatest("own", "x").alias("q"), "node", "root", "own")
        sketch = F.when(F.col("sig").bitwiseAND(F.lit(1)) == 0, F.col("even")).otherwise(F.col("odd"))
        rows = many.join(self.held.select("node", "n", "even", "odd"), "node").select("sig", "p", "q", "node", "root", "own", "n", sketch.alias("sketch"))

        def each(batch, cuts):
            cols = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
            node, size, group, block, p, q, sig = (cols[k].to_numpy() for k in ("node", "n", "root", "own", "p", "q", "sig"))
            parity = plan.band(size) & 1
            low, high = [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if b - a < 2 or (group[a:b] == group[a]).all():
                    continue
                marks = np.frombuffer(b"".join(cols["sketch"].slice(a, b - a).to_pylist()), np.uint8).reshape(b - a, -1)
                most, step = 2 * marks.shape[1] // FINE - 1, max(1, TOGETHER // (b - a))
                for c in range(a, b, step):
                    j, i = (x.ravel() for x in np.meshgrid(np.arange(c, min(c + step, b)), np.arange(a, b), indexing="ij"))
                    fits = (i < j) & (group[i] != group[j]) & (10 * np.minimum(size[i], size[j]) >= 9 * np.maximum(size[i], size[j]))
                    fits &= np.where(size[i] < size[j], parity[i], parity[j]) == (sig[a] & 1)
                    if p[a] != q[a]:  # pairs within a block belong to that block's own task
                        fits &= block[i] != block[j]
                    i, j = i[fits], j[fits]
                    if len(i):
                        near = np.concatenate([_HALVES[marks[i[k : k + 512] - a] ^ marks[j[k : k + 512] - a]].sum(axis=1) for k in range(0, len(i), 512)]) <= most
                        low.append(node[i[near]])
                        high.append(node[j[near]])
            if low:
                one, two = np.concatenate(low), np.concatenate(high)
                pair = np.unique(np.stack([np.minimum(one, two), np.maximum(one, two)], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0].copy()), pa.array(pair[:, 1].copy())], ["a", "b"])

        return listed.union(_grouped(rows, ["sig", "p", "q"], each, "a bigint, b bigint")).distinct()

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Pairs whose sets, made again from the whole texts, are similar enough."""
        side = self.held.select("node", "body")
        met = pairs.join(side.toDF("a", "ta").hint("merge"), "a").join(side.toDF("b", "tb").hint("merge"), "b").select("a", "b", "ta", "tb")

        def each(batch):
            reader, a, b, i = zstandard.ZstdDecompressor(), batch.column(2), batch.column(3), 0
            while i < batch.num_rows:
                texts, size, j = [], 0, i
                while j < batch.num_rows and size < bs.PIECE:
                    for side in (a, b):
                        texts.append(reader.decompress(side[j].as_buffer()))
                        size += len(texts[-1])
                    j += 1
                offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
                h, first = sets(np.frombuffer(b"".join(texts), np.uint8), offs)
                n = np.diff(first)
                both = shared(h, first)
                at = np.flatnonzero(100 * both >= 90 * (n[0::2] + n[1::2] - both))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(at)), batch.column(1).slice(i, j - i).take(pa.array(at))], ["a", "b"])
                i = j

        return mapped(met, each, "a bigint, b bigint")

    def named(self) -> DataFrame:
        """(node, component_id, root): the smallest id of each node's component, and the node that stands for it."""
        if self.buckets.limit(1).count():
            self.texts()
            edges = stash(self.linked(self.star_pairs()), "first")
            root = stash(components(edges), "roots")
            more = stash(self.linked(self.rest_pairs(root)), "second")
            if more.limit(1).count():
                root = stash(components(edges.union(more)), "roots")
            least = self.classes.join(root, "node").groupBy("root").agg(F.min("least_id").alias("linked_id"))
            linked = root.join(least, "root").select("node", "linked_id", "root")
            named = self.classes.join(linked, "node", "left").select("node", F.coalesce("linked_id", "least_id").alias("component_id"), F.coalesce("root", "node").alias("root"))
        else:
            named = self.classes.select("node", F.col("least_id").alias("component_id"), F.col("node").alias("root"))
        return stash(named, "named")

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) for each row."""
        words = self.rows.filter("n > 0").select("doc_id", "n", "node").join(self.named(), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
        return words.union(self.rows.filter("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    return Join(docs).result()


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each component, that of the least (doc_id, text hash); ids come before none.  Rows without words stay."""
    run = Join(docs, keyed=True)
    root = run.named().select("node", "root")
    own = run.rows.filter("n > 0").select("node", "doc_id", *KEY).join(root, "node")
    own = stash(own.groupBy("root", "doc_id", *KEY).agg(F.count("*").alias("copies")), "own")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *KEY)
    best = own.groupBy("root").agg(F.min(order).alias("best"), F.count("*").alias("rivals"))
    # Components of one row, nearly all, need no join back.
    crowded = stash(best.filter("rivals > 1").select("root", "best"), "crowded")
    gone = stash(own.join(crowded, "root").filter(order != F.col("best")).select("doc_id", *KEY), "gone")
    again = stash(own.filter("copies > 1").select("doc_id", *KEY), "again")
    hashed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("doc_id").alias("_id"), *[h.alias(f"_{k}") for h, k in zip(text_key(), KEY, strict=True)])
    # Whole rows move only where their text hash may be one of these; all others are kept as they are read.
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(gone.union(again), KEY[0]))

    @F.arrow_udf("boolean")
    def named_too(h: pa.Array) -> pa.Array:
        return pa.array(inside(h.to_numpy(zero_copy_only=False).view(np.uint64), *bits.value))

    clear, kept = (hashed.filter(f) for f in (~named_too(f"_{KEY[0]}"), named_too(f"_{KEY[0]}")))

    def met(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        named = keys.toDF("id", *KEY)
        return rows.join(named, F.col("_id").eqNullSafe(named["id"]) & (F.col(f"_{KEY[0]}") == named[KEY[0]]) & (F.col(f"_{KEY[1]}") == named[KEY[1]]), how)

    kept = met(kept, gone, "left_anti")
    if again.limit(1).count():
        once = met(kept, again, "left_semi").dropDuplicates(["_id", *[f"_{k}" for k in KEY]])
        kept = met(kept, again, "left_anti").unionByName(once)
    kept = clear.unionByName(kept)
    return kept.select("_row.*")
