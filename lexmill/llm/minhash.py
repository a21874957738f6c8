"""MinHash near-dedup with an LSH forest.

Documents with the same shingle set form one class, kept as one representative. Every
representative has ``TREES * DEPTH`` minhash values; tree t orders all representatives by
their values rotated to start at its own, so each order is a sorted signature order whose
longest-common-prefix neighbours stand side by side. The depth adapts to the region: where few
representatives share ``THIN_DEPTH`` leading values all of them are candidates of each other;
where more do, ``LEAST_DEPTH`` common values are needed; and in crowded regions (copies of one
text) the order goes on through all values, and those who share most of them stand together.

Candidates are confirmed on full shingle sets in two passes. The first confirms, for every
document, its best candidate and its smallest one, and joins what is linked. The second
confirms every other candidate whose ends are still apart. So every candidate is either
confirmed, refuted or already known to be in the same component, and a group of thousands of
copies costs about as many confirmations as it has members.

The orders propose neighbours, the smallest id and the most central member of a region, which
joins most groups. What they leave is looked at exactly: in every region whose members are
still in different components, all pairs of members from different components meet with their
full sets, in blocks of ``BLOCK`` members, and only links leave a block; in crowded regions of
documents that are no copies of each other they meet by their rarest shingles, by the prefix
filter of set joins, which loses no link either. Regions are found by
their key, so neither crowding nor the cuts of the range partitioning lose a pair. The chance
that a pair at the threshold shares no region in any tree is about (1 - 0.85**4)**16, less than
one in 100,000, and (1 - 0.85**3)**16, less than one in a million, where regions are thin.

Defined results: words are split at blank and \\t-\\r and lower-cased in A-Z; a text of fewer
than ``SHINGLE`` words has one shingle, all its words; null and empty texts have none and
link with nothing; rows with equal ids are one document and get its result each; of their
texts, if they differ, the one with the smallest set key counts for links, and each row has the
size of its own set; rows with a null id link with nothing; other columns are ignored or passed
through; ids must be integers, others raise a TypeError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lexmill.llm import kernels as K
from lexmill.llm.components import components, merged
from lexmill.session import discard, materialise, ship

SHINGLE = 5
#: Percent of the union that two sets must share.
PERCENT = 85
#: Trees of the forest, and the minhash values that are each tree's own.
TREES, DEPTH = 16, 4
#: Common leading values that make two neighbours candidates, in thin regions and elsewhere.
THIN_DEPTH, LEAST_DEPTH = 3, 4
#: Neighbours looked at on either side in each order.
NEAR = 8
VALUES = TREES * DEPTH
#: Members of a region that meet at once in the exact pass.
BLOCK = 256
#: Blocks beside the largest component of a region from which its members meet by rare shingles.
CROWD = 8
#: Documents with a common rare shingle that meet at once, and bits of the buckets that count shingles.
POSTING, RARE_BITS = 4096, 20
#: Agreeing values (of all) below which a pair at the threshold is out of the question:
#: more than five standard deviations below the mean of 54.
LEAST_AGREE = 39

_MULTIPLY = K.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_ADD = K.mix(np.arange(1001, VALUES + 1001, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """rows x VALUES uint32 minhash values; all ones for empty rows."""
    out = np.full((len(offsets) - 1, VALUES), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        starts = offsets[:-1][full]
        for j in range(VALUES):
            h = sets * _MULTIPLY[j]
            h += _ADD[j]
            h ^= h >> np.uint64(29)
            h *= np.uint64(0xBF58476D1CE4E5B9)
            out[full, j] = np.minimum.reduceat((h >> np.uint64(32)).astype(np.uint32), starts)
    return out


def set_keys(sets: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """A 128-bit key of every set, as two numbers."""
    keys = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        c = np.zeros(len(sets) + 1, np.uint64)
        np.cumsum(K.mix(sets ^ np.uint64(salt)), out=c[1:])
        keys.append((c[offsets[1:]] - c[offsets[:-1]]).view(np.int64))
    return keys


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sig): size, 128-bit key and minhash values of each set."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b, d, o in K.slices(data, offsets):
                h, so = K.shingle_sets(d, o, SHINGLE)
                sig = signatures(h, so)
                keys = set_keys(h, so)
                packed = pa.Array.from_buffers(pa.binary(4 * VALUES), b - a, [None, pa.py_buffer(np.ascontiguousarray(sig).tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(np.diff(so)), pa.array(keys[0]), pa.array(keys[1]), packed], ["doc_id", "n_shingles", "k1", "k2", "sig"])

    source = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"doc_id {kind}, n_shingles bigint, k1 bigint, k2 bigint, sig binary")


def _orders(reps: DataFrame, kind: str) -> DataFrame:
    """(tree, label, doc_id, n): each representative once in every tree.

    The label has the tree's own values in full, then one byte of every further value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint32).reshape(n, VALUES)
            for t in range(TREES):
                turned = np.roll(sig, -t * DEPTH, axis=1)
                head = np.ascontiguousarray(turned[:, :DEPTH]).astype(">u4").view(np.uint8).reshape(n, 4 * DEPTH)
                label = np.concatenate([head, (turned[:, DEPTH:] >> 11).astype(np.uint8)], axis=1)
                packed = pa.Array.from_buffers(pa.binary(label.shape[1]), n, [None, pa.py_buffer(label.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), packed, batch.column(0), batch.column(1)], ["tree", "label", "doc_id", "n"])

    return reps.select("doc_id", "n_shingles", "sig").mapInArrow(run, f"tree int, label binary, doc_id {kind}, n bigint")


def _central(label: np.ndarray) -> int:
    """The row whose bytes are the most common ones of their columns: the middle of a group."""
    cell = label + 256 * np.arange(label.shape[1])
    return int(np.bincount(cell.ravel(), minlength=256 * label.shape[1])[cell].sum(1).argmax())


def _neighbours(orders: DataFrame, kind: str) -> DataFrame:
    """(a, b, agree): candidate pairs from sorted runs; rows arrive in tree and label order."""
    width = 4 * DEPTH + VALUES - DEPTH

    def same(tree, label, depth):
        """Which rows share their tree and leading values with the row before."""
        out = np.zeros(len(tree), bool)
        out[1:] = (tree[1:] == tree[:-1]) & (label[1:, : 4 * depth] == label[:-1, : 4 * depth]).all(1)
        return out

    def pairs(tree, label, ids, n):
        same_head = same(tree, label, LEAST_DEPTH)
        run_no = np.cumsum(~same_head)
        first = np.flatnonzero(~same_head)
        out = []

        def add(x, y):
            agree = DEPTH + (label[x, 4 * DEPTH :] == label[y, 4 * DEPTH :]).sum(1)
            small, large = np.minimum(n[x], n[y]), np.maximum(n[x], n[y])
            ok = (agree >= LEAST_AGREE) & (100 * small >= PERCENT * large) & (ids[x] != ids[y])
            x, y, agree = x[ok], y[ok], agree[ok]
            out.append((np.minimum(ids[x], ids[y]), np.maximum(ids[x], ids[y]), agree))

        for d in range(1, NEAR + 1):
            if d < len(ids):
                x = np.flatnonzero(run_no[d:] == run_no[:-d])
                if not len(x):
                    break
                add(x, x + d)
        # thin regions at the smaller depth, whole
        thin_no = np.cumsum(~same(tree, label, THIN_DEPTH))
        size = np.bincount(thin_no)[thin_no]
        for d in range(1, min(NEAR + 1, len(ids))):
            x = np.flatnonzero((thin_no[d:] == thin_no[:-d]) & (run_no[d:] != run_no[:-d]) & (size[d:] <= NEAR + 1))
            add(x, x + d)
        # the smallest id of each region, against all its members
        if len(ids):
            order = np.lexsort((ids, run_no))
            least = order[np.searchsorted(run_no[order], run_no[first])]
            size = np.bincount(run_no)[run_no]
            x = np.flatnonzero(size > NEAR + 1)
            add(least[run_no[x] - run_no[0]], x)
            for members in np.split(x, np.flatnonzero(np.diff(run_no[x])) + 1) if len(x) else ():
                add(np.full(len(members), members[_central(label[members])]), members)
        a, b, g = (np.concatenate([o[i] for o in out]) if out else np.zeros(0, np.int64) for i in range(3))
        return a, b, g

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []
        for batch in batches:
            m = len(batch)
            if not m:
                continue
            tree = batch.column(0).to_numpy()
            label = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(m, width)
            block = [tree, label, batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()]
            if held:  # the last region of the batch before goes on; of a long one its end, smallest id and center
                block = [np.concatenate([h, x]) for h, x in zip(held, block, strict=True)]
            a, b, g = pairs(*block)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(g.astype(np.int32))], ["a", "b", "agree"])
            last = (block[0] == block[0][-1]) & (block[1][:, : 4 * LEAST_DEPTH] == block[1][-1, : 4 * LEAST_DEPTH]).all(1)
            members = np.flatnonzero(last)
            center = members[_central(block[1][members])]
            thin = np.flatnonzero((block[0] == block[0][-1]) & (block[1][:, : 4 * THIN_DEPTH] == block[1][-1, : 4 * THIN_DEPTH]).all(1))
            keep = np.unique(np.concatenate([[members[np.argmin(block[2][members])], center], members[-NEAR:], thin[-NEAR:]]))
            held = [x[keep] for x in block]

    return orders.mapInArrow(run, f"a {kind}, b {kind}, agree int")


def _regions(reps: DataFrame, kind: str) -> DataFrame:
    """(region, doc_id): the regions of at least two representatives and their members.

    A region is a tree and the ``LEAST_DEPTH`` leading values of its members there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(n, VALUES)
            for t in range(TREES):
                head = np.roll(sig, -t * DEPTH, axis=1)[:, :LEAST_DEPTH]
                key = np.ascontiguousarray(np.concatenate([np.full((n, 1), t, np.uint32), head], axis=1))
                packed = pa.Array.from_buffers(pa.binary(4 * LEAST_DEPTH + 4), n, [None, pa.py_buffer(key.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([packed, batch.column(0)], ["region", "doc_id"])

    keyed = reps.select("doc_id", "sig").mapInArrow(run, f"region binary, doc_id {kind}")
    shared = keyed.groupBy("region").agg(F.count("*").alias("n")).where("n > 1").select("region")
    return keyed.join(shared, "region")


def _apart(regions: DataFrame, reps: DataFrame, sets: DataFrame, known: DataFrame, kind: str, block: int = BLOCK, crowd: int = CROWD) -> DataFrame:
    """(a, b): links between the components that members of a region are in.

    The largest component of a region needs no pairs of its own, so its blocks meet only the
    blocks of the others; those meet each other too. A pair is looked at in its first common
    tree; what a block has linked is one component in it from then on. Where more than ``crowd``
    blocks are left beside the largest component, members meet by their rarest shingles instead.
    """
    named = regions.join(known.select(F.col("node").alias("doc_id"), "component"), "doc_id", "left").select("region", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    parts = named.groupBy("region", "c").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("region").agg(F.sum("n").alias("n"), F.max(F.struct("n", "c")).alias("top"), F.count("*").alias("parts")).where("parts > 1")
    mixed = materialise(mixed.select("region", F.col("top.c").alias("main"), F.ceil(F.col("top.n") / block).alias("nm"), F.ceil((F.col("n") - F.col("top.n")) / block).alias("nk")), "mixed")
    if mixed.isEmpty():
        return known.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    many = named.join(mixed.where(F.col("nk") > crowd).select("region"), "region", "left_semi").select("doc_id", "c").distinct()
    many = materialise(many, "many")
    inside = F.col("c") == F.col("main")
    members = named.join(mixed.where(F.col("nk") <= crowd), "region").withColumn("own", F.when(inside, F.pmod(F.xxhash64("doc_id"), "nm")).otherwise(F.col("nm") + F.pmod(F.xxhash64("doc_id"), "nk")))
    members = materialise(members, "members").join(reps.select("doc_id", "sig"), "doc_id").join(sets, "doc_id")
    meets = members.withColumn("other", F.explode(F.sequence(F.when(inside, F.col("nm")).otherwise(F.lit(0)), F.col("nm") + F.col("nk") - 1)))
    dealt = meets.select("region", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "c", "sig", "shingles")

    def links(rows: pa.Table) -> pa.RecordBatch:
        lo, hi, own, ids, c = (rows.column(k).to_numpy() for k in ("lo", "hi", "own", "doc_id", "c"))
        sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), np.uint32).reshape(len(ids), VALUES)
        shingles = rows.column("shingles").combine_chunks()
        flat = shingles.flatten().to_numpy()
        n = shingles.value_lengths().to_numpy()
        at = np.append(0, np.cumsum(n))
        region = rows.column("region").to_pylist()
        new = np.ones(len(ids), bool)
        new[1:] = [x != y for x, y in zip(region[1:], region[:-1], strict=True)]
        new[1:] |= (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        edges = np.append(np.flatnonzero(new), len(ids))
        a, b = [], []
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            tree = int.from_bytes(region[s][:4], "little")
            local, group = None, c[s:e].copy()
            for x in range(s, e):
                y = np.arange(x + 1, e)
                y = y[(group[y - s] != group[x - s]) & ((lo[x] == hi[x]) | (own[y] != own[x]))]
                y = y[100 * np.minimum(n[y], n[x]) >= PERCENT * np.maximum(n[y], n[x])]
                equal = sig[y] == sig[x]
                near = (equal.sum(1) >= LEAST_AGREE) & (equal.reshape(-1, TREES, DEPTH).all(2).argmax(1) == tree)
                y = y[near]
                if not len(y):
                    continue
                if local is None:
                    names, local = np.unique(flat[at[s] : at[e]], return_inverse=True)
                    mark = np.zeros(len(names), bool)
                mine = local[at[x] - at[s] : at[x + 1] - at[s]]
                mark[mine] = True
                others = np.concatenate([local[at[i] - at[s] : at[i + 1] - at[s]] for i in y])
                shared = np.add.reduceat(mark[others].astype(np.int64), np.append(0, np.cumsum(n[y])[:-1]))
                mark[mine] = False
                for i in y[100 * shared >= PERCENT * (n[x] + n[y] - shared)]:
                    if group[i - s] != group[x - s]:
                        group[group == group[i - s]] = group[x - s]
                        a.append(min(c[x], c[i]))
                        b.append(max(c[x], c[i]))
        return pa.RecordBatch.from_arrays([pa.array(a, rows.schema.field("doc_id").type), pa.array(b, rows.schema.field("doc_id").type)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            rows = pa.Table.from_batches([batch])
            if held is not None:
                rows = pa.concat_tables([held, rows])
            # the last block of the batch may go on
            last = [rows.column(k)[-1] for k in ("region", "lo", "hi")]
            at = len(rows)
            while at and [rows.column(k)[at - 1] for k in ("region", "lo", "hi")] == last:
                at -= 1
            if at:
                yield links(rows.slice(0, at))
            held = rows.slice(at)
        if held is not None:
            yield links(held)

    keys = ("region", "lo", "hi")
    out = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, f"a {kind}, b {kind}").distinct()
    return out if many.isEmpty() else out.unionByName(_rare_links(many, sets, kind))


def _rare_links(members: DataFrame, sets: DataFrame, kind: str, block: int = POSTING) -> DataFrame:
    """(a, b): links between the components c of ``members`` (doc_id, c), by a prefix-filtered join.

    Sets that share PERCENT of their union share one of their rarest shingles: of n, those up to
    the first that leaves fewer than PERCENT of n behind it. Rarity is counted in 2**RARE_BITS
    buckets of shingles among the members, and any order that is the same for all sets is
    right. So documents that share a template and have words of their own meet nowhere. A shingle
    that many of them begin with is dealt in pairs of blocks. Candidates are confirmed on full sets.
    """
    rows = materialise(members.join(sets, "doc_id"), "crowd")
    bucket = F.shiftrightunsigned(F.col("s"), 64 - RARE_BITS).cast("int")
    counts = rows.select(F.explode("shingles").alias("s")).groupBy(bucket.alias("b")).agg(F.count("*").alias("n")).toArrow()
    often = np.zeros(1 << RARE_BITS, np.uint32)
    often[counts.column("b").to_numpy()] = np.minimum(counts.column("n").to_numpy(), 0xFFFFFFFF)
    shared = rows.sparkSession.sparkContext.broadcast(often)

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            n = lists.value_lengths().to_numpy()
            flat = lists.flatten().to_numpy()
            row = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((flat, shared.value[(flat.view(np.uint64) >> np.uint64(64 - RARE_BITS)).astype(np.int64)], row))
            place = np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)
            kept = place < (n - -(-PERCENT * n // 100) + 1)[row]
            row, token = row[kept], flat[order][kept]
            ids = batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(token), *ids, pa.array(n[row].astype(np.int64)), pa.array(place[kept].astype(np.int64))], ["token", "doc_id", "c", "n", "place"])

    begins = materialise(rows.select("doc_id", "c", "shingles").mapInArrow(prefixes, f"token bigint, doc_id {kind}, c {kind}, n bigint, place bigint"), "prefixes")
    met = begins.groupBy("token").agg(F.ceil(F.count("*") / block).alias("blocks"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("token", "blocks")
    own = begins.join(met, "token").withColumn("own", F.pmod(F.xxhash64("doc_id"), "blocks"))
    meets = own.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    keys = ("token", "lo", "hi")
    dealt = meets.select("token", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "doc_id", "c", "n", "place")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)

    def pairs(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Candidates of whole groups of rows with the same keys."""
        token, lo, hi, own, ids, c, n, place = held
        new = np.ones(len(ids), bool)
        new[1:] = (token[1:] != token[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
        edges = np.append(np.flatnonzero(new), len(ids))
        for s, e in zip(edges[:-1], edges[1:], strict=True):
            for x in range(s, e - 1):
                y = np.arange(x + 1, e)
                least, most = np.minimum(n[y], n[x]), np.maximum(n[y], n[x])
                room = np.minimum(n[y] - place[y], n[x] - place[x])  # shingles they may share from here on
                y = y[(c[y] != c[x]) & ((lo[x] == hi[x]) | (own[y] != own[x])) & (100 * least >= PERCENT * most) & ((100 + PERCENT) * room >= PERCENT * (n[y] + n[x]))]
                if len(y):
                    swap = ids[y] < ids[x]
                    one, two = np.where(swap, ids[y], ids[x]), np.where(swap, ids[x], ids[y])
                    yield pa.RecordBatch.from_arrays([pa.array(v) for v in (one, two, np.where(swap, c[y], c[x]), np.where(swap, c[x], c[y]))], ["a", "b", "ca", "cb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if not len(batch):
                continue
            rows = [batch.column(i).to_numpy() for i in range(8)]
            rows = [np.concatenate([h, x]) for h, x in zip(held, rows, strict=True)] if held else rows
            last = (rows[0] == rows[0][-1]) & (rows[1] == rows[1][-1]) & (rows[2] == rows[2][-1])
            cut = len(last) - int(last[::-1].argmin()) if not last.all() else 0
            if cut:
                yield from pairs([x[:cut] for x in rows])
            held = [x[cut:] for x in rows]  # the last group may go on
        if held:
            yield from pairs(held)

    found = materialise(dealt.mapInArrow(run, f"a {kind}, b {kind}, ca {kind}, cb {kind}").distinct(), "candidates")
    return _confirmed(found, sets).select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, shingles): full sets of the wanted documents.

    The wanted ids grow with the corpus, so texts and ids are dealt by id at every size
    instead of sending the ids to every task while they happen to be few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = K.buffers(batch.column(1))
            for a, b, d, o in K.slices(data, offsets):
                h, so = K.shingle_sets(d, o, SHINGLE)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, set_keys(h, so)), pa.ListArray.from_arrays(pa.array(so, pa.int32()), pa.array(h.view(np.int64)))], ["doc_id", "k1", "k2", "shingles"])

    picked = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(wanted.hint("merge"), "doc_id", "left_semi")
    kind = picked.schema[0].dataType.simpleString()
    found = picked.mapInArrow(run, f"doc_id {kind}, k1 bigint, k2 bigint, shingles array<bigint>").where("size(shingles) > 0")
    return found.groupBy("doc_id").agg(F.min_by("shingles", F.struct("k1", "k2")).alias("shingles"))


def _contracted(links: DataFrame, kind: str) -> DataFrame:
    """(a, b): the links, with those of each batch of rows as stars around their smallest ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            up: dict[int, int] = {}

            def root(x: int) -> int:
                top = x
                while (y := up.setdefault(top, top)) != top:  # noqa: B023
                    top = y
                while x != top:
                    x, up[x] = up[x], top  # noqa: B023
                return top

            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = root(x), root(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            ends = [(x, root(x)) for x in list(up)]
            ends = [e for e in ends if e[0] != e[1]]
            yield pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], batch.schema.field(0).type) for k in (0, 1)], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, f"a {kind}, b {kind}")


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets share at least PERCENT of their union, with their other columns."""
    left = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    both = left.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= PERCENT * (F.size("sa") + F.size("sb") - shared)).select(*pairs.columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    if not isinstance(docs.schema["doc_id"].dataType, IntegralType):
        raise TypeError("doc_id must be an integer column")
    signed = materialise(_signed(docs), "signed")
    kind = signed.schema["doc_id"].dataType.simpleString()
    full = signed.where("n_shingles > 0 and doc_id is not null")
    # one set for each id: ids with several are rare, and looked for in the narrow columns alone
    least = full.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("m"), F.max(F.struct("k1", "k2")).alias("top")).where("m <> top")
    several = materialise(least.select(F.col("doc_id").alias("id"), F.col("m.k1").alias("m1"), F.col("m.k2").alias("m2")), "several")
    same_id = F.col("doc_id") == F.col("id")
    full = full.join(several, same_id & ((F.col("k1") != F.col("m1")) | (F.col("k2") != F.col("m2"))), "left_anti")
    reps = full.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("r"))
    reps = materialise(reps.select("k1", "k2", "r.*"), "classes")
    ordered = _orders(reps, kind).repartitionByRange("tree", "label", "doc_id").sortWithinPartitions("tree", "label", "doc_id")
    pairs = _neighbours(ordered, kind).groupBy("a", "b").agg(F.max("agree").alias("agree"))
    pairs = materialise(pairs, "pairs")
    regions = materialise(_regions(reps, kind), "regions")
    sets = materialise(_sets(docs, regions.select("doc_id").distinct()), "sets")
    # first pass: everyone's best candidate, and its smallest
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y"), "agree").unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y"), "agree"))
    best = ends.groupBy("x").agg(F.min(F.struct(-F.col("agree"), "y")).alias("m"), F.min("y").alias("least")).select("x", F.explode(F.array_distinct(F.array("m.y", "least"))).alias("y"))
    first = materialise(best.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "first")
    links = _contracted(_confirmed(first, sets), kind)
    known = materialise(components(links), "known")
    # second pass: whatever is still apart
    side = lambda c: known.select(F.col("node").alias(c), F.col("component").alias(f"c{c}"))
    rest = pairs.join(first, ["a", "b"], "left_anti").join(side("a"), "a", "left").join(side("b"), "b", "left")
    rest = rest.select("a", "b", F.coalesce("ca", "a").alias("ca"), F.coalesce("cb", "b").alias("cb")).where("ca <> cb")
    known = merged(known, _confirmed(rest, sets).select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    # exact pass: members of a region in different components
    member = merged(known, _apart(regions, reps, sets, known, kind))
    discard(pairs, first, regions, sets)
    classes = reps.select("k1", "k2", F.col("doc_id").alias("rep")).join(member.select(F.col("node").alias("rep"), "component"), "rep", "left").select("k1", "k2", F.coalesce("component", "rep").alias("c"))
    keyed = signed.select("doc_id", "n_shingles", "k1", "k2").join(several, same_id, "left")
    out = keyed.select("doc_id", "n_shingles", F.coalesce("m1", "k1").alias("k1"), F.coalesce("m2", "k2").alias("k2")).join(classes, ["k1", "k2"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("c")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(F.col("doc_id") == own, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each component."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("__id")).distinct()
    return docs.join(gone, F.col("doc_id") == F.col("__id"), "left_anti")
