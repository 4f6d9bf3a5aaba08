"""N-gram Jaccard join by parity sketches.

Each text is a set of word shingles. Its sketch deals the shingles over parts
by the leading bits of their hashes, and each part holds the XOR of its
shingles' codes: one shingle more or less changes one part, so the number of
parts in which two sketches differ is at most the size of the sets' symmetric
difference. Two texts with a Jaccard similarity of at least 3/4 and sizes a
and b differ in at most (a + b) / 7 shingles; of so many parts and one more
that are not empty, one is equal. Texts of one size band have the same number
of parts and are joined on equal parts; a second, dense sketch of single
parity bits then discards candidates by Hamming distance, and the rest are
verified on their texts.

Shingles that very many texts share are left out of the sketches. Texts that
then have too few parts left also enter a finer join on single shingles: the
first quarter of each set and one more, those that few texts have before the
others, of which similar sets have one in common. So nothing is lost.

Groups of texts with an equal part are not expanded into pairs. Of groups with
the same members one is kept. Each member is first compared with one hub, and
connected components are made. Then members of different components are
compared by their dense sketches inside of tasks: a group is dealt over cells
of bounded size, so that each member outside of the group's largest component
meets every other one in some cell, and a cell gives no more than a forest of
pairs that ties together what its sketches allow to link. The forest is
verified. Components that it ties together wrongly are few; each bundle of them
is dealt over cells once more, now with whole sets of shingles, and a cell
gives a forest of links that hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.llm.arrowtext import mix, slices, text_bytes
from cadenza.llm.graph import components
from cadenza.llm.shingles import row_sums, shingle_sets
from cadenza.plans.scratch import Scratch

#: The dense sketch has a power of two of bits, about three for a shingle, at least and at most so many.
LEAST_BITS, MOST_BITS = 64, 8192
#: Shared shingles are noted by so many leading bits of their hash: a table of fixed size, 512 KiB.
SHARED_BITS = 22
#: A shingle is shared if so many texts have it, or this fraction of them if that is more.
SHARED_LEAST, SHARED_FRACTION = 50, 1e-4
#: Shared shingles deal their texts over so many groups, each with a hub of its own; 64 at most, which are bits of a long.
SALTS = 64
#: A cell has members of about so many shingles in all, members of few shingles counting as many as LEAST_WEIGHT.
CELL_WEIGHT, LEAST_WEIGHT = 1 << 20, 256
#: Documents the text filter of the verification can tell apart: a table of fixed size, 512 KiB.
FILTER_BITS = 22

_A, _B, _CODE, _PART, _SINGLE = (np.uint64(x) for x in (0x51ED270B9F1A3C05, 0x2B5A5F2D1E6C7A91, 0x7C3A1D5E9B2F4861, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _bits(n: np.ndarray) -> np.ndarray:
    """Bits of the dense sketch of sets of n shingles."""
    return np.clip(1 << (np.frexp(np.maximum(n, 1).astype(float))[1].astype(np.int64) + 1), LEAST_BITS, MOST_BITS)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size, two hashes and dense sketch; of shingles met more than once in a slice, their counts by leading bits."""
    names = ["kind", "id", "n", "h1", "h2", "sketch"]
    sketch_type = pa.list_(pa.int64())
    for batch in slices(batches):
        h, at = shingle_sets(*text_bytes(batch.column(1)))
        n, rows = np.diff(at), batch.num_rows
        h1, h2 = row_sums(mix(h ^ _A), at), row_sums(mix(h ^ _B), at)
        row = np.repeat(np.arange(rows), n)
        bits = _bits(n)
        begin = np.cumsum(bits) - bits
        bit = np.bincount(begin[row] + (h & (bits[row] - 1).astype(np.uint64)).astype(np.int64), minlength=int(bits.sum())).astype(np.uint8) & 1
        sketch = np.packbits(bit, bitorder="little").view(np.int64)
        sketch = pa.ListArray.from_arrays(pa.array(np.append(begin, bits.sum()).astype(np.int32) // 64), pa.array(sketch)).cast(sketch_type)
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(rows, np.int8)), batch.column(0), pa.array(n), pa.array(_signed(h1)), pa.array(_signed(h2)), sketch], names)
        once = np.zeros(rows, bool)
        once[np.unique(h1, return_index=True)[1]] = True
        found, times = np.unique(h[once[row]], return_counts=True)
        found, times = found[times > 1], times[times > 1]
        if len(found):
            k = len(found)
            zero = pa.array(np.zeros(k, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int8)), pa.array((found >> np.uint64(64 - SHARED_BITS)).astype(np.int64)), pa.array(times), zero, zero, pa.nulls(k, sketch_type)], names)


def _most_apart(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band of each set size; the largest symmetric difference to a partner, of the same band or above, and of the band below (-1: none there)."""
    band = np.frexp(np.maximum(n, 1).astype(float))[1] - 1
    low = (1 << band.astype(np.int64)) - 1
    own = (n + n * 4 // 3) // 7
    below = np.where((band > 0) & (4 * low >= 3 * n), (n + low) // 7, -1)
    return band.astype(np.int64), own, below


def _signatures(shared: np.ndarray):
    """Rows (key, salt, node): what a document is joined on. shared: table of shared shingles by leading bits; keys of theirs have a salt, others -1."""

    def keys(h: np.ndarray, at: np.ndarray, band: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and rows of each row's first apart + 1 parts that are not empty, and which rows have fewer."""
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        part = np.where(band[row] > 0, h >> (np.uint64(64) - np.maximum(band[row], 1).astype(np.uint64)), np.uint64(0))
        if not len(h):
            return np.zeros(0, np.uint64), row, apart >= 0
        new = np.ones(len(h), bool)
        new[1:] = (part[1:] != part[:-1]) | (row[1:] != row[:-1])
        begin = np.flatnonzero(new)
        lane = np.bitwise_xor.reduceat(mix(h ^ _CODE), begin)
        row, part = row[begin], part[begin]
        first = np.searchsorted(row, np.arange(len(at)))
        few = np.diff(first) <= apart
        use = np.arange(len(row)) - first[row] <= apart[row]
        key = mix(lane ^ mix(part ^ (band[row].astype(np.uint64) << np.uint64(56)) ^ _PART))
        return key[use], row[use], few & (apart >= 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, seen = shared.value, set()
        for batch in slices(batches):
            h, at = shingle_sets(*text_bytes(batch.column(0)))
            node = row_sums(mix(h ^ _A), at)
            n = np.diff(at)
            fresh = np.zeros(len(n), bool)
            for k, x in enumerate(node.tolist()):
                if n[k] and x not in seen:
                    seen.add(x)
                    fresh[k] = True
            if len(seen) > 1_000_000:
                seen.clear()
            row = np.repeat(np.arange(len(n)), n)
            bucket = h >> np.uint64(64 - SHARED_BITS)
            common = ((table[bucket >> np.uint64(3)] >> (bucket & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
            rare = fresh[row] & ~common
            band, own, below = _most_apart(n)
            own, below = np.where(fresh, own, -1), np.where(fresh, below, -1)
            r_at = np.searchsorted(row[rare], np.arange(len(n) + 1))
            k1, r1, few1 = keys(h[rare], r_at, band, own)
            k2, r2, few2 = keys(h[rare], r_at, np.maximum(band - 1, 0), below)
            finer = np.flatnonzero((few1 | few2)[row])
            finer = finer[np.argsort(2 * row[finer] + common[finer], kind="stable")]  # by row, those of few texts first, then by hash
            finer = finer[np.arange(len(finer)) - np.searchsorted(row[finer], row[finer]) <= n[row[finer]] // 4]
            key = np.concatenate([k1, k2, mix(h[finer] ^ _SINGLE)])
            of = np.concatenate([r1, r2, row[finer]])
            salt = np.full(len(key), -1, np.int8)
            tail = salt[len(key) - len(finer) :]
            tail[:] = np.where(common[finer], (node[row[finer]] % np.uint64(SALTS)).astype(np.int8), -1)
            yield pa.RecordBatch.from_arrays([pa.array(_signed(key)), pa.array(salt), pa.array(_signed(node)[of])], ["key", "salt", "node"])

    return run


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key, salt and node to (key, salt, hub, node) of the groups with several nodes or a salt; the hub is a group's first node. Holds one row of state."""
    last = None  # key, salt, node and hub of the row before, and whether that is its group's only one so far and not given out
    for batch in batches:
        key, salt, node = (np.asarray(c) for c in batch.columns)
        if not len(key):
            continue
        if last is not None:
            key, salt, node = np.append(last[0], key), np.append(last[1], salt), np.append(last[2], node)
        new = np.append(True, (key[1:] != key[:-1]) | (salt[1:] != salt[:-1]))
        keep = new.copy()
        keep[1:] |= node[1:] != node[:-1]
        key, salt, node, new = key[keep], salt[keep], node[keep], new[keep]
        begin = np.flatnonzero(new)
        hubs = node[begin]
        size = np.diff(np.append(begin, len(key)))
        given = np.zeros(len(key), bool)
        if last is not None:
            hubs[0], given[0] = last[3], not last[4]
        several = (size > 1) | (salt[begin] >= 0)
        several[0] |= bool(given[0])
        of = np.cumsum(new) - 1
        out = several[of] & ~given
        if out.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[out]) for x in (key, salt, hubs[of], node)], ["key", "salt", "hub", "node"])
        last = key[-1:], salt[-1:], node[-1:], hubs[-1], bool(size[-1] == 1 and not several[-1])


def _close(sketch: np.ndarray, at: np.ndarray, n: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) have sketches close enough. Of sketches of different sizes the larger one's halves are XORed."""
    ok, words = np.zeros(len(i), bool), np.diff(at)
    w = np.minimum(words[i], words[j])
    for size in np.unique(w).tolist():
        own = np.flatnonzero(w == size)
        for lo in range(0, len(own), max(1, (1 << 20) // size)):
            part = own[lo : lo + max(1, (1 << 20) // size)]
            a, b = i[part], j[part]
            span = np.arange(size)
            x = sketch[at[a][:, None] + span] ^ sketch[at[b][:, None] + span]
            for side in (a, b):
                wide = words[side] > size
                x[wide] ^= sketch[at[side[wide]][:, None] + size + span]
            ok[part] = 7 * np.bitwise_count(x).sum(1, dtype=np.int64) <= n[a] + n[b]
    return ok


def _similar(sets: np.ndarray, at: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which of the pairs (i, j) have sets similar enough. Pairs with one i should follow each other."""
    n = np.diff(at)
    both = np.zeros(len(i), np.int64)
    begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
    for lo, hi in zip(begin, np.append(begin[1:], len(i)), strict=True):
        own, others = sets[at[i[lo]] : at[i[lo] + 1]], j[lo:hi]
        size = n[others]
        end = np.cumsum(size)
        values = sets[np.arange(end[-1]) + np.repeat(at[others] - (end - size), size)]
        place = np.minimum(np.searchsorted(own, values), len(own) - 1)
        both[lo:hi] = np.add.reduceat(own[place] == values, end - size, dtype=np.int64)
    return 100 * both >= 75 * (n[i] + n[j] - both)


def _forest(comp: np.ndarray, node: np.ndarray, n: np.ndarray, member: np.ndarray, probe: np.ndarray, loose: np.ndarray, sketch: tuple[np.ndarray, np.ndarray], sets: tuple[np.ndarray, np.ndarray] | None) -> list[tuple[int, int]]:
    """Pairs of nodes, one fewer than the components they tie together: probes against members, by sketches and, where sets are given, by these."""
    tree = np.unique(comp, return_inverse=True)[1]
    root = np.arange(len(comp) and int(tree.max()) + 1)
    found = []
    others = np.flatnonzero(member)
    every = np.flatnonzero(probe)
    block = max(1, 200_000 // max(1, len(others)))
    for lo in range(0, len(every), block):
        p = every[lo : lo + block][:, None]
        a, b = n[p], n[others]
        fits = 4 * np.minimum(a, b) >= 3 * np.maximum(a, b)
        fits &= (root[tree[p]] != root[tree[others]]) & (~loose[others] | (node[p] < node[others]))
        i, j = np.nonzero(fits)
        i, j = p[i, 0], others[j]
        ok = _close(*sketch, n, i, j)
        i, j = i[ok], j[ok]
        while len(i):
            apart = root[tree[i]] != root[tree[j]]
            i, j = i[apart], j[apart]
            some = len(i) if sets is None else max(1, int(np.searchsorted(np.cumsum(n[j]), 1 << 18)))
            x, y = i[:some], j[:some]
            i, j = i[some:], j[some:]
            if sets is not None:
                ok = _similar(*sets, x, y)
                x, y = x[ok], y[ok]
            kinds = np.unique(root[tree[x]] * len(root) + root[tree[y]], return_index=True)[1]
            for u, v in zip(x[kinds].tolist(), y[kinds].tolist(), strict=True):
                r, s = root[tree[u]], root[tree[v]]
                if r != s:
                    root[root == s] = r
                    found.append((int(node[u]), int(node[v])))
    return found


def _ties(batches: Iterator[pa.RecordBatch], exact: bool) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell to each cell's forest of pairs (a, b), a < b. exact: the rows have whole sets, and the pairs hold."""

    def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        length = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
        return np.asarray(column.flatten()).view(np.uint64), np.append(0, np.cumsum(length))

    def pairs(cell: pa.RecordBatch) -> list[tuple[int, int]]:
        comp, node, n, member, probe, loose = (c.to_numpy(zero_copy_only=False) for c in cell.columns[1:7])
        return _forest(comp, node, n, member, probe, loose, lists(cell.column(7)), lists(cell.column(8)) if exact else None)

    def out(found: list[tuple[int, int]]) -> pa.RecordBatch:
        x = np.unique(np.sort(np.array(found, np.int64), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["a", "b"])

    rest: list[pa.RecordBatch] = []
    found: list[tuple[int, int]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cell = np.asarray(batch.column(0))
        cut = np.flatnonzero(cell[1:] != cell[:-1]) + 1
        if rest and rest[-1].column(0)[-1].as_py() != cell[0]:
            cut = np.append(0, cut)
        at = 0
        for to in cut.tolist():
            rest.append(batch.slice(at, to - at))
            found += pairs(pa.concat_batches(rest))
            rest, at = [], to
            if len(found) > 100_000:
                yield out(found)
                found = []
        rest.append(batch.slice(at))
    if rest:
        found += pairs(pa.concat_batches(rest))
    if found:
        yield out(found)


def _dealt(members: DataFrame, payload: DataFrame, exact: bool) -> DataFrame:
    """The pairs (a, b) that cells of ``members`` (key, comp, node, n) give. payload: node and what is compared, its sketch and, if exact, its set.

    A group whose members have one component gives nothing. Of the others the
    members are dealt over blocks, and those outside of the largest component
    over blocks of probes; a cell is a block of members with one of probes.
    """
    weight = F.greatest("n", F.lit(LEAST_WEIGHT))
    of = members.groupBy("key", "comp").agg(F.sum(weight).alias("w"))
    of = of.groupBy("key").agg(F.sum("w").alias("w"), F.max("w").alias("most"), F.max_by("comp", F.struct("w", "comp")).alias("largest"), F.count("*").alias("comps")).where("comps > 1")
    of = of.select("key", "largest", F.ceil(F.col("w") / CELL_WEIGHT).alias("blocks"), F.ceil((F.col("w") - F.col("most")) / CELL_WEIGHT).alias("probes"))
    x = members.join(of, "key").withColumn("loose", F.col("comp") != F.col("largest"))
    x = x.withColumn("b", F.pmod(F.xxhash64("node"), "blocks")).withColumn("p", F.pmod(F.xxhash64("node", F.lit(1)), "probes"))
    cell = lambda b, p: F.struct(b.alias("b"), p.alias("p"))
    own = F.transform(F.sequence(F.lit(0).cast("long"), F.col("probes") - 1), lambda p: cell(F.col("b"), p))
    met = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda b: cell(b, F.col("p")))
    x = x.withColumn("at", F.explode(F.when(F.col("loose"), F.array_union(own, met)).otherwise(own)))
    x = x.select(F.xxhash64("key", "at.b", "at.p").alias("cell"), "comp", "node", "n", (F.col("at.b") == F.col("b")).alias("member"), (F.col("loose") & (F.col("at.p") == F.col("p"))).alias("probe"), "loose")
    x = x.join(payload, "node").select("cell", "comp", "node", "n", "member", "probe", "loose", *payload.columns[1:])
    return x.repartition("cell").sortWithinPartitions("cell").mapInArrow(partial(_ties, exact=exact), "a long, b long").distinct()


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) whose texts are similar enough, by their whole sets of shingles."""
    for batch in slices(batches, "ta", 1 << 20):
        (ha, at_a), (hb, at_b) = (shingle_sets(*text_bytes(batch.column(k))) for k in (2, 3))
        keep = np.zeros(batch.num_rows, bool)
        for k in range(batch.num_rows):
            a, b = ha[at_a[k] : at_a[k + 1]], hb[at_b[k] : at_b[k + 1]]
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep[k] = both > 0 and 100 * both >= 75 * (len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in batch.columns[:2]], ["a", "b"])


def _linked(edges: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidate pairs of nodes, as pairs (a, b) of documents, that hold."""
    spark = docs.sparkSession
    x = edges.join(nodes.select(F.col("node").alias("a"), F.col("rep").alias("ra"), F.col("n").alias("na"), F.col("sketch").alias("sa")), "a")
    x = x.join(nodes.select(F.col("node").alias("b"), F.col("rep").alias("rb"), F.col("n").alias("nb"), F.col("sketch").alias("sb")), "b")
    x = x.where(4 * F.least("na", "nb") >= 3 * F.greatest("na", "nb"))
    words = F.least(F.size("sa"), F.size("sb"))

    def cut(s: str) -> Column:
        """The sketch, or its halves XORed if the other one is half as long."""
        halves = F.zip_with(F.slice(s, F.lit(1), words), F.slice(s, words + 1, words), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(s) > words, halves).otherwise(F.col(s))

    apart = F.aggregate(F.zip_with(cut("sa"), cut("sb"), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda s, v: s + v)
    x = x.where(7 * apart <= F.col("na") + F.col("nb")).select("ra", "rb")
    texts = _texts_of(docs, x.select(F.col("ra").alias("id")).union(x.select(F.col("rb").alias("id"))))
    x = x.join(texts.select(F.col("id").alias("ra"), F.col("text").alias("ta")), "ra")
    x = x.join(texts.select(F.col("id").alias("rb"), F.col("text").alias("tb")), "rb")
    return x.select("ra", "rb", "ta", "tb").mapInArrow(_verify, "a long, b long")


def _texts_of(docs: DataFrame, needed: DataFrame, then=lambda batches: batches, kind: str = "id long, text string") -> DataFrame:
    """id and text of documents, those whose id is in ``needed`` and few others; or what ``then`` makes of them in the same worker."""
    slot = F.shiftrightunsigned(F.xxhash64("id"), 64 - FILTER_BITS).alias("slot")
    slots = needed.select(slot).distinct().toPandas().slot.to_numpy()  # at most 2 ** FILTER_BITS
    bits = np.zeros(1 << FILTER_BITS, np.uint8)
    bits[slots] = 1
    table = docs.sparkSession.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = np.asarray(batch.column(2))
            hit = (table.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(hit.astype(bool))) for c in batch.columns[:2]], ["id", "text"])

    return docs.select(F.col("doc_id").alias("id"), "text").where("id IS NOT NULL").withColumn("slot", slot).mapInArrow(lambda batches: then(wanted(batches)), kind)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, text) to id, node and the set of shingles."""
    for batch in slices(batches):
        h, at = shingle_sets(*text_bytes(batch.column(1)))
        node = row_sums(mix(h ^ _A), at)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_signed(node)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(_signed(h)))], ["rep", "node", "shingles"])


def link(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs (doc_id long, text string; other columns are not read).

    component_id is the smallest doc_id that is reachable over links. Texts
    that are null, empty or have no word have an empty set, no link and their
    own id. Equal texts, and repeated rows, share a component. Rows with the
    same doc_id count as one document: links of any of their texts hold for
    all. A null doc_id has no part in links; its component is null. An empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "ngram-join")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    seen = scratch.save(docs.mapInArrow(_describe, "kind byte, id long, n long, h1 long, h2 long, sketch array<long>"))
    info = seen.where("kind = 0")
    total = info.count()
    least = max(SHARED_LEAST, int(total * SHARED_FRACTION))
    buckets = seen.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("id").toPandas().id.to_numpy()  # at most 2 ** SHARED_BITS
    bits = np.zeros(1 << SHARED_BITS, np.uint8)
    bits[buckets] = 1
    shared = spark.sparkContext.broadcast(np.packbits(bits, bitorder="little"))

    sets = info.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = scratch.save(sets.withColumnRenamed("h1", "node"))
    signed = docs.where("doc_id IS NOT NULL").select("text").mapInArrow(_signatures(shared), "key long, salt byte, node long")
    grouped = signed.repartition("key", "salt").sortWithinPartitions("key", "salt", "node").mapInArrow(_groups, "key long, salt byte, hub long, node long")
    every = scratch.save(grouped)
    # Near-duplicates share very many keys; of keys with the same members one is enough.
    salts = F.expr("bit_or(CASE WHEN salt >= 0 THEN shiftleft(1L, salt) ELSE 0L END)").alias("salts")
    sets = every.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), salts).where("n > 1")
    one = sets.groupBy("n", "x", "y").agg(F.min_by("salts", "key").alias("salts"), F.min("key").alias("key"))
    listed = f"CASE WHEN salts = 0 THEN array(-1) ELSE filter(sequence(0, {SALTS - 1}), s -> (shiftright(salts, s) & 1) = 1) END"
    one = one.select("key", F.explode(F.expr(listed).cast("array<tinyint>")).alias("salt"))
    groups = scratch.save(every.join(one, ["key", "salt"], "left_semi"))
    scratch.drop(every)
    tied = groups.where("hub <> node").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    hubs = groups.where("salt >= 0").select("key", "hub").distinct()
    tied = tied.union(hubs.join(hubs.groupBy("key").agg(F.min("hub").alias("a")), "key").where("a <> hub").select("a", F.col("hub").alias("b")))
    first = scratch.save(tied.distinct())
    linked = scratch.save(_linked(first, nodes, docs))
    # A doc_id with several texts ties their sets together.
    same = info.where("n > 0 AND id IS NOT NULL").join(nodes.select(F.col("node").alias("h1"), "h2", "rep"), ["h1", "h2"])
    same = same.groupBy("id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo <> hi")
    held = linked.union(same.select(F.col("id").alias("a"), F.col("lo").alias("b"))).union(same.select(F.col("id").alias("a"), F.col("hi").alias("b")))
    comps = scratch.save(components(held, scratch))

    def labelled(*more: str) -> DataFrame:
        """Every node with its component so far."""
        return nodes.join(comps.withColumnRenamed("node", "rep"), "rep", "left").select("node", F.coalesce("component", "rep").alias("comp"), "n", *more)

    def merged(links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return comps
        new = scratch.save(components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links), scratch))
        for table in (links, comps):
            scratch.drop(table)
        return new

    across = scratch.save(_dealt(groups.select("key", "node").join(labelled(), "node"), nodes.select("node", "sketch"), False))
    scratch.drop(groups)
    comps = merged(scratch.save(_linked(across.exceptAll(first), nodes, docs)))
    ends = across.join(labelled().select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a").join(labelled().select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b")
    wrong = scratch.save(ends.where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct())
    if not wrong.isEmpty():
        bundles = components(wrong, scratch).select(F.col("node").alias("comp"), F.col("component").alias("key"))
        members = scratch.save(labelled("rep", "sketch").join(bundles, "comp"))
        sets = _texts_of(docs, members.select(F.col("rep").alias("id")), _sets, "rep long, node long, shingles array<long>").dropDuplicates(["rep", "node"])
        payload = members.select("node", "rep", "sketch").join(sets, ["rep", "node"]).select("node", "sketch", "shingles")
        pairs = _dealt(members.select("key", "comp", "node", "n"), payload, True)
        reps = nodes.select("node", "rep")
        pairs = pairs.join(reps.select(F.col("node").alias("a"), F.col("rep").alias("ra")), "a").join(reps.select(F.col("node").alias("b"), F.col("rep").alias("rb")), "b")
        comps = merged(scratch.save(pairs.select("ra", "rb")))
        scratch.drop(members)
    for table in (first, linked, across, wrong):
        scratch.drop(table)

    reps = nodes.select(F.col("node").alias("h1"), "h2", "rep")
    out = info.select(F.col("id").alias("doc_id"), "n", "h1", "h2").join(reps, ["h1", "h2"], "left")
    out = out.join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    own = F.when(F.col("n") > 0, F.coalesce("component", "rep")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), own).alias("component_id"))


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate class."""
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
