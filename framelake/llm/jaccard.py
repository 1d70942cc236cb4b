"""Exact Jaccard similarity join of texts as sets of word n-grams, in a metric space.

Jaccard distance is a metric, so a pivot p bounds any pair: |d(x,p) - d(y,p)| <= d(x,y). In a text collection nearly all
distances are close to 1, from any pivot, and windows of Voronoi cells over the whole collection would replicate every
document to every cell. The join therefore has two levels.

1. Regions. The n-gram universe is cut by hash into one part more than the largest symmetric difference that a linked
   pair of such sizes can have, so a linked pair agrees on a whole part. Equal parts are edges of a graph (a star to the
   part's first set, never all pairs); its components are regions that no link leaves. Sizes are distances from the
   empty set: sets near the border of a size class are replicated to the class below. Passages that many texts share make
   large regions without links; a set can only link if num/den of its n-grams stand in other sets of its region, so the
   others go (a count for each n-gram, of one row a task at most where it is frequent; most sets go by a share of their
   n-grams already). The rest is parted by its rare n-grams: of linked sets each has the rarest common one among the
   rarest (1 - num/den) of its own and one more, so passages that many sets share join none that are not made of them.
2. Voronoi cells. A region of more than `leaf_rows` sets or `leaf_bytes` of text is dealt to pivots: each set goes to its
   nearest pivot's cell and, as a boundary set, to every cell whose pivot is at most two radii farther. Cells are dealt
   again until they fit a task; a cell that pivots can't part is joined by blocks: sets that links to pivots join to one
   class need no comparison with each other, so only the sets outside of the largest class are compared with the others.
   In a leaf, pivots prune by the triangle inequality and what is left is compared exactly.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm import graph
from framelake.llm.words import mix, shingle_sets

GROWTH = 1.4
COMBINE_ROWS = 300_000
#: N-grams that a task of `linkable` counts among themselves before they are shuffled, and sums that one holds.
CHUNK_ROWS = 2_000_000
HELD_ROWS = 1_000_000
#: The first pass of `linkable` looks at so many times the share of n-grams that a linked set may have alone.
FIRST_LOOK = 1.75
PIVOTS = 12
LEAF_ROWS = 1500
LEAF_BYTES = 24 << 20


# --- size classes and parts ------------------------------------------------------------------------------------------


def class_floor(k: int) -> int:
    """Least set size of class k."""
    return _floors(k + 2)[k]


_FLOORS = [1]


def _floors(n: int) -> list[int]:
    while len(_FLOORS) < n:
        _FLOORS.append(max(_FLOORS[-1] + 1, int(_FLOORS[-1] * GROWTH)))
    return _FLOORS


def class_of(n: int) -> int:
    while _FLOORS[-1] <= n:
        _floors(len(_FLOORS) + 1)
    return int(np.searchsorted(_FLOORS, n, "right")) - 1


_PARTS: dict[tuple[int, int, int], tuple[int, int]] = {}


def parts_of(k: int, num: int, den: int) -> tuple[int, int]:
    """Parts for class k, and the most of them that a linked pair whose smaller set is in the class can differ in.

    There is one part more than that, and some more where parts are so small that several will be empty."""
    if (k, num, den) not in _PARTS:
        low, a = _floors(k + 2)[k], _floors(k + 2)[k + 1] - 1
        b = den * a // num
        most = (a + b) * (den - num) // (den + num)
        m = most + 1
        for _ in range(8):
            empty = m * math.exp(-1.1 * low / m)  # about so many
            m = most + 1 + math.ceil(max(0.0, empty + 2 * math.sqrt(empty) - 0.3)) if most else 1
        _PARTS[k, num, den] = (min(m, 2 * most + 1), most)
    return _PARTS[k, num, den]


_EDGES: dict[int, np.ndarray] = {}


def part_edges(m: int) -> np.ndarray:
    if m not in _EDGES:
        _EDGES[m] = np.array([(j << 64) // m + bool((j << 64) % m) for j in range(1, m)], dtype=np.uint64)
    return _EDGES[m]


SEEDS = np.array([0, 0x1B873593CC9E2D51, 0x2545F4914F6CDD1D], dtype=np.uint64)


def part_keys(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Keys such that two linked, different sets share at least one. h: sorted distinct hashes.

    Of m parts a linked pair agrees on m - most at least. Where a set has fewer empty parts, one of those has elements and
    is a key. A set with as many empty parts is cut again with another seed; at the last seed empty parts are keys too.
    """
    n = len(h)
    least = -(-num * n // den)
    out = []
    for k in range(class_of(max(least, 1)), class_of(n) + 1):
        m, most = parts_of(k, num, den)
        if most == 0:
            continue  # only equal sets link
        for s, seed in enumerate(SEEDS):
            x = h if s == 0 else np.sort(mix(h ^ seed))
            cum = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(x), out=cum[1:])
            cuts = np.concatenate(([0], np.searchsorted(x, part_edges(m)), [n]))
            lo, hi = cuts[:-1], cuts[1:]
            full = hi > lo
            tag = np.uint64((k * 8 + s) << 32) + np.arange(m, dtype=np.uint64)
            keys = mix((cum[hi] - cum[lo]) ^ mix(tag))
            out.append(keys if s == len(SEEDS) - 1 else keys[full])
            if m - full.sum() < m - most:
                break
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


# --- tasks over texts ------------------------------------------------------------------------------------------------


def digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _node(d: bytes) -> int:
    return int.from_bytes(d[:8], "little", signed=True)


def _sets_task(n: int):
    def task(batches):
        for b in batches:
            ids, size, dig, chars = b.column(0), [], [], pc.utf8_length(b.column(1)).cast(pa.int64())
            for _, x in shingle_sets(b.column(1), n):
                size.append(len(x))
                dig.append(digest(x) if len(x) else None)
            yield pa.record_batch(
                [ids, pa.array(size, pa.int64()), pa.array(dig, pa.binary()), pa.array([None if d is None else _node(d) for d in dig], pa.int64()), chars],
                names=["doc_id", "n_shingles", "digest", "node", "chars"],
            )

    return task


def _keys_task(n: int, num: int, den: int):
    """Rows (key, node) of parts; what a task has of one key is combined to one row and links to that row's node."""

    def combined(keys, nodes):
        key, node = np.concatenate(keys), np.concatenate(nodes)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        first = np.concatenate(([True], key[1:] != key[:-1]))
        lead = node[first][np.cumsum(first) - 1]
        more = ~first & (node != lead)
        pairs = np.unique(np.stack([node[more], lead[more]], axis=1), axis=0)
        k = np.concatenate([key[first].view(np.int64), pairs[:, 0]])
        a = np.concatenate([node[first], pairs[:, 0]])
        b = np.concatenate([np.zeros(first.sum(), np.int64), pairs[:, 1]])
        none = np.arange(len(k)) < first.sum()
        for i in range(0, len(k), 50_000):
            j = slice(i, i + 50_000)
            yield pa.record_batch([pa.array(k[j]), pa.array(a[j]), pa.array(b[j], mask=none[j])], names=["key", "a", "b"])

    def task(batches):
        keys, nodes, seen, rows = [], [], set(), 0
        for batch in batches:
            for _, x in shingle_sets(batch.column(1), n):
                if not len(x) or (node := _node(digest(x))) in seen:
                    continue
                seen.add(node)
                k = part_keys(x, num, den)
                keys.append(k)
                nodes.append(np.full(len(k), node, np.int64))
                rows += len(k)
                if rows >= COMBINE_ROWS:
                    yield from combined(keys, nodes)
                    keys, nodes, seen, rows = [], [], set(), 0
        if rows:
            yield from combined(keys, nodes)

    return task


def _stars_task(batches):
    """Sorted (key, a, b): links pass; rows of one key are linked to the key's first node. Holds one batch."""
    last_key, lead = None, 0
    for batch in batches:
        key, a = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
        link = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
        out_a, out_b = [a[link]], [batch.column(2).fill_null(0).to_numpy(zero_copy_only=False)[link]]
        key, a = key[~link], a[~link]
        if len(key):
            first = np.concatenate(([key[0] != last_key], key[1:] != key[:-1]))
            heads = np.concatenate(([lead], a[first]))
            to = heads[np.cumsum(first)]
            last_key, lead = key[-1], to[-1]
            more = ~first & (a != to)
            out_a.append(a[more])
            out_b.append(to[more])
        pairs = np.unique(np.stack([np.concatenate(out_a), np.concatenate(out_b)], axis=1), axis=0)
        if len(pairs):
            yield pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


# --- leaves ----------------------------------------------------------------------------------------------------------


class _Space:
    """Sets over their own small universe; exact intersections of all with one of them. What only one set has is left out."""

    DENSE_CELLS = 24 << 20

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(x) for x in sets], np.int64)
        universe, ids, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        shared = count[ids] > 1
        row = np.repeat(np.arange(len(sets)), self.sizes)[shared]
        name = np.cumsum(count > 1) - 1
        self.ids = name[ids[shared]]
        self.off = np.searchsorted(row, np.arange(len(sets) + 1))
        width = int((count > 1).sum())
        self.dense = None
        if width and len(sets) * width <= self.DENSE_CELLS:
            self.dense = np.zeros((len(sets), width), np.float32)
            self.dense[row, self.ids] = 1
        self.mark = np.zeros(width, np.int64)

    def shared(self, i: int) -> np.ndarray:
        if self.dense is not None:
            return (self.dense @ self.dense[i]).astype(np.int64)
        mine = self.ids[self.off[i] : self.off[i + 1]]
        self.mark[mine] = 1
        upto = np.concatenate(([0], np.cumsum(self.mark[self.ids])))
        self.mark[mine] = 0
        out = upto[self.off[1:]] - upto[self.off[:-1]]
        out[i] = self.sizes[i]
        return out

    def jaccard(self, i: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
        """Distances of all sets from set i, and which of them it links to."""
        s = self.shared(i)
        s[i] = self.sizes[i]
        u = np.maximum(self.sizes[i] + self.sizes - s, 1)
        return 1 - s / u, den * s >= num * u


def link_leaf(sets: list[np.ndarray], num: int, den: int, probe: np.ndarray | None = None, within: bool = True) -> np.ndarray:
    """Class (least row reachable by links) of every set.

    probe: if given, only pairs with such a row are compared; within: whether pairs of two such rows are."""
    n = len(sets)
    cls = np.arange(n)

    def join(rows):
        found = np.unique(cls[rows])
        if len(found) > 1:
            cls[np.isin(cls, found)] = found[0]

    if n == 1:
        return cls
    sp = _Space(sets)
    radius = (den - num) / den + 1e-9
    dist, covered, best = [], np.zeros(n, bool), -1  # covered: linked to one pivot, so of one class
    at = int(np.argsort(sp.sizes)[n // 2])
    for _ in range(3 if n > 8 else 1):
        d, near = sp.jaccard(at, num, den)
        join(np.append(np.flatnonzero(near), at))
        dist.append(d)
        if near.sum() > best:
            best, covered = near.sum(), near
        at = int(np.argmax(np.min(dist, axis=0)))
    done = np.zeros(n, bool)  # a pair of two such rows was compared when the first one's turn came
    if probe is not None and not within:
        done |= probe
    for i in np.flatnonzero(~covered if probe is None else probe):
        done[i] = True
        ok = ~done & (cls != cls[i]) & (den * np.minimum(sp.sizes, sp.sizes[i]) >= num * np.maximum(sp.sizes, sp.sizes[i]))
        for d in dist:
            ok &= np.abs(d - d[i]) <= radius
        if ok.any():
            join(np.append(np.flatnonzero(sp.jaccard(i, num, den)[1] & ok), i))
    return cls


def _leaf_task(n: int, num: int, den: int):
    def task(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        ids, probe, within = table.column("doc_id").to_numpy(), table.column("probe").to_numpy(), table.column("within")[0].as_py()
        sets = [x for _, x in shingle_sets(table.column("text"), n)]
        full = np.array([len(x) > 0 for x in sets])
        sets, ids, probe = [x for x in sets if len(x)], ids[full], probe[full]
        if not sets:
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        c = link_leaf(sets, num, den, None if probe.all() and within else probe, within)
        return pa.table({"a": ids, "b": ids[c]})

    return task


def _pivot_task(n: int, num: int, den: int):
    """Docs of a region's share with the region's pivots: cells of each document and links to pivots."""
    radius = (den - num) / den

    def task(docs: pa.Table, pivots: pa.Table) -> pa.Table:
        none = pa.table({
            "region": pa.array([], pa.int64()), "doc_id": pa.array([], pa.int64()), "chars": pa.array([], pa.int64()),
            "cell": pa.array([], pa.int64()), "home": pa.array([], pa.bool_()), "linked": pa.array([], pa.bool_()),
        })
        if docs.num_rows == 0 or pivots.num_rows == 0:
            return none
        docs, pivots = docs.combine_chunks(), pivots.combine_chunks()
        sets = [
            x for _,
            x in shingle_sets(
                pa.concat_arrays([docs.column("text").combine_chunks().cast(pa.string()), pivots.column("text").combine_chunks().cast(pa.string())]),
                n,
            )
        ]
        m, sp = docs.num_rows, _Space(sets)
        pid = pivots.column("doc_id").to_numpy()
        dist, near = np.empty((len(pid), m)), np.empty((len(pid), m), bool)
        for j in range(len(pid)):
            d, link = sp.jaccard(m + j, num, den)
            dist[j], near[j] = d[:m], link[:m]
        home = dist.argmin(axis=0)
        reach = dist <= dist.min(axis=0) + 2 * radius + 1e-9
        reach[home, np.arange(m)] = True
        j, i = np.nonzero(reach)
        take = docs.select(["region", "doc_id"]).take(pa.array(i))
        chars = pc.utf8_length(docs.column("text")).to_numpy()[i].astype(np.int64)
        return pa.table({
            "region": take.column("region"), "doc_id": take.column("doc_id"), "chars": pa.array(chars), "cell": pa.array(pid[j]),
            "home": pa.array(home[i] == j), "linked": pa.array(near[j, i]),
        })

    return task


# --- the join --------------------------------------------------------------------------------------------------------


def shingle_table(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest (null for a text without words), node (64 bits of the digest) and chars of every row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        _sets_task(n), "doc_id long, n_shingles long, digest binary, node long, chars long",
    )


def regions(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, component: sets that may link, directly or by others, share a component."""
    keys = docs.select("doc_id", "text").mapInArrow(_keys_task(n, num, den), "key long, a long, b long")
    stars = keys.repartition("key").sortWithinPartitions("key", "a").mapInArrow(_stars_task, "a long, b long")
    return graph.components(stars)


def common_least(size: int, num: int, den: int) -> int:
    """N-grams that a set of this size has in common with any that it links to, at least."""
    return -(-num * size // den)


def _region_grams(batch, n: int):
    """(node, n-grams) of the sets of a batch (region, text): a key stands for an n-gram in a region."""
    salt = mix(batch.column(0).to_numpy().astype(np.int64).view(np.uint64))
    for i, x in shingle_sets(batch.column(1), n):
        if len(x):
            yield _node(digest(x)), mix(x ^ salt[i])


def _shingle_rows_task(n: int, num: int, den: int, share: float):
    """Rows (key, node, shared, least) of the n-grams of sets in regions, or of a share of them that is the same for all sets.

    An n-gram that only one set of a run of sets has is a row of its own with that set's node. One that several have is a
    row without node, and counts at once: each set has a row of its own (shared >= 0) of how many it has of those, and of
    how many the set needs to have in common with others if it is to link (least)."""

    def counted(keys, nodes, least):
        size = np.array([len(k) for k in keys], np.int64)
        key, inverse, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        owner = np.repeat(np.arange(len(nodes)), size)
        again = count[inverse] > 1
        shared = np.bincount(owner[again], minlength=len(nodes))
        ids, k = np.array(nodes, np.int64), np.concatenate(keys)
        own = np.concatenate([k[~again].view(np.int64), key[count > 1].view(np.int64), ids])
        node = np.concatenate([ids[owner[~again]], np.zeros((count > 1).sum(), np.int64), ids])
        part = np.repeat([0, 1, 2], [(~again).sum(), (count > 1).sum(), len(ids)])
        full = np.concatenate([np.full((part < 2).sum(), -1), shared])
        needs = np.concatenate([np.zeros((part < 2).sum(), np.int64), np.array(least, np.int64)])
        for i in range(0, len(own), 50_000):
            j = slice(i, i + 50_000)
            yield pa.record_batch(
                [pa.array(own[j]), pa.array(node[j], mask=part[j] == 1), pa.array(full[j]), pa.array(needs[j])],
                names=["key", "node", "shared", "least"],
            )

    def task(batches):
        keys, nodes, least, rows = [], [], [], 0
        for batch in batches:
            for node, x in _region_grams(batch, n):
                seen = x if share >= 1 else x[x < np.uint64(int(share * 2**64))]
                keys.append(seen)
                nodes.append(node)
                least.append(max(0, len(seen) - (len(x) - common_least(len(x), num, den))))
                rows += len(seen) + 1
                if rows >= CHUNK_ROWS:
                    yield from counted(keys, nodes, least)
                    keys, nodes, least, rows = [], [], [], 0
        if nodes:
            yield from counted(keys, nodes, least)

    return task


def _shared_task(batches):
    """Sorted (key, node, shared, least): (node, shared, least) partly summed; an n-gram of two rows is shared.

    Holds a batch, a row, and sums of HELD_ROWS rows at most."""
    held: tuple[int, int | None] | None = None  # a key's only row so far
    last, rows = None, 0
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(node, count, least):
        parts.append((node, count, least))
        return len(node)

    def summed():
        node, count, least = (np.concatenate(x) for x in zip(*parts, strict=True))
        d, at = np.unique(node, return_inverse=True)
        z = np.zeros(len(d), np.int64)
        np.maximum.at(z, at, least)
        parts[:] = [(d, np.bincount(at, count, len(d)).astype(np.int64), z)]
        return len(d)

    def batch_of_sums():
        return pa.record_batch([pa.array(x) for x in parts[0]], names=["node", "shared", "least"])

    for batch in batches:
        shared, least = batch.column(2).to_numpy(), batch.column(3).to_numpy()
        own = shared >= 0
        rows += add(batch.column(1).fill_null(0).to_numpy()[own], shared[own], least[own])
        key = batch.column(0).to_numpy()[~own]
        known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)[~own]
        ids = batch.column(1).fill_null(0).to_numpy()[~own]
        if len(key):
            again = np.zeros(len(key), bool)
            again[1:] = key[1:] == key[:-1]
            again[:-1] |= key[1:] == key[:-1]
            if last == key[0]:
                again[0] = True
                if held is not None and held[0] == key[0] and held[1] is not None:
                    rows += add(np.array([held[1]]), np.ones(1, np.int64), np.zeros(1, np.int64))
            last = int(key[-1])
            held = None if again[-1] else (last, int(ids[-1]) if known[-1] else None)
            take = again & known
            rows += add(ids[take], np.ones(take.sum(), np.int64), np.zeros(take.sum(), np.int64))
        if rows >= HELD_ROWS:
            rows = summed()
            if rows >= HELD_ROWS // 2:
                yield batch_of_sums()
                parts.clear()
                rows = 0
    if rows:
        summed()
        yield batch_of_sums()


def texts_of(docs: DataFrame, ids: DataFrame, repeated: bool) -> DataFrame:
    """region, doc_id, text of stored ids (doc_id, region). repeated: whether rows of docs repeat a doc_id."""
    texts = docs.join(graph.small(ids.select("doc_id", "region")), "doc_id").select("region", "doc_id", "text")
    return texts.distinct() if repeated else texts


def linkable(docs: DataFrame, ids: DataFrame, repeated: bool, n: int, num: int, den: int) -> DataFrame:
    """Those stored ids (node, doc_id, region) whose sets have num/den of their n-grams in common with others of their region.

    A linked set has less than 1 - num/den of its n-grams alone, of a share of them no more either: so most of the sets go
    by a first pass over a share that is the same n-grams for all, and the pass over all n-grams has few sets left."""
    first = FIRST_LOOK * (1 - num / den)
    for share in (first, 1.0) if 0 < first < 0.7 else (1.0,):
        grams = texts_of(docs, ids, repeated).select("region", "text").mapInArrow(
            _shingle_rows_task(n, num, den, share), "key long, node long, shared long, least long",
        )
        counts = grams.repartition("key").sortWithinPartitions("key").mapInArrow(_shared_task, "node long, shared long, least long")
        counts = counts.groupBy("node").agg(F.sum("shared").alias("shared"), F.max("least").alias("least"))
        stay = graph.cut(counts.where("shared >= least").select("node"))
        ids = graph.cut(ids.join(graph.small(stay), "node"))
    return ids


def _grams_task(n: int, num: int, den: int):
    """Rows (key, node, least): the n-grams of sets in regions, and how many of a set's have to be common for it to link."""

    def task(batches):
        for batch in batches:
            keys, nodes, least, rows = [], [], [], 0
            for node, x in _region_grams(batch, n):
                keys.append(x.view(np.int64))
                nodes.append(node)
                least.append(common_least(len(x), num, den))
                rows += len(x)
            if rows:
                key, size = np.concatenate(keys), [len(x) for x in keys]
                node, needs = np.repeat(np.array(nodes, np.int64), size), np.repeat(np.array(least, np.int64), size)
                for i in range(0, rows, 50_000):
                    j = slice(i, i + 50_000)
                    yield pa.record_batch([pa.array(key[j]), pa.array(node[j]), pa.array(needs[j])], names=["key", "node", "least"])

    return task


def rare_regions(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """node, component of sets (region, text) that may link, directly or by others, by the order of how many sets have an n-gram.

    Of size - least + 1 n-grams that come first in one order of all n-grams, linked sets have their first common one. N-grams
    that one set has alone come before all others and are left out: that is as many places less."""
    grams = texts.select("region", "text").mapInArrow(_grams_task(n, num, den), "key long, node long, least long")
    count = graph.cut(grams.groupBy("key").agg(F.count("*").alias("sets")).where("sets > 1"))
    of_set = Window.partitionBy("node")
    ranked = grams.join(count, "key").withColumns({
        "place": F.row_number().over(of_set.orderBy("sets", "key")), "held": F.count("*").over(of_set),
    })
    first = graph.cut(ranked.where("place <= held - least + 1").select("key", "node"))
    lead = first.groupBy("key").agg(F.min("node").alias("b"))
    return graph.components(first.join(lead, "key").where("node <> b").select(F.col("node").alias("a"), "b"))


def _voronoi(rows: DataFrame, n: int, num: int, den: int, leaf_rows: int, leaf_bytes: int, rounds: int = 4) -> list[DataFrame]:
    """Links (a, b) inside regions too large for a task. rows: region long, doc_id, text."""
    links, leaf = [], _leaf_task(n, num, den)
    for depth in range(rounds):
        draw = F.pmod(F.xxhash64(F.lit(depth), "doc_id"), F.lit(1 << 30)) / F.lit(1 << 30)
        count = graph.cut(rows.groupBy("region").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(draw).alias("least")))
        shares = F.ceil(F.greatest(F.col("n") / leaf_rows, 4 * F.col("chars") / leaf_bytes)).cast("int")
        sized = rows.join(graph.small(count.withColumn("shares", shares)), "region")
        docs = sized.withColumn("share", F.pmod(F.xxhash64("doc_id"), F.col("shares")).cast("int"))
        pivots = sized.where((draw < 2 * PIVOTS / F.col("n")) | (draw == F.col("least"))).withColumn("draw", draw)
        pivots = pivots.groupBy("region", "shares").agg(F.slice(
            F.array_sort(F.collect_list(F.struct("draw", "doc_id", "text"))), 1, PIVOTS,
        ).alias("p"))
        pivots = pivots.select("region", "shares", F.explode("p").alias("p")).select(
            "region", "p.doc_id", "p.text", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        )
        pivots = graph.cut(pivots).select(*[F.col(c).alias(c) for c in pivots.columns])
        dealt = docs.select("region", "share", "doc_id", "text").groupBy("region", "share").cogroup(pivots.groupBy("region", "share")).applyInArrow(
            _pivot_task(n, num, den), "region long, doc_id long, chars long, cell long, home boolean, linked boolean",
        )
        dealt = graph.cut(dealt)
        to_pivot = dealt.where("linked and doc_id <> cell").select(F.col("doc_id").alias("a"), F.col("cell").alias("b"))
        links.append(to_pivot)
        cells = dealt.groupBy("region", "cell").agg(F.count("*").alias("n"), F.sum("chars").alias("chars"))
        fits = (F.col("n") <= leaf_rows) & (F.col("chars") * 4 <= leaf_bytes)
        cells = cells.withColumn("kind", F.when(fits, "leaf").otherwise("again"))
        whole = cells.groupBy("region").agg(F.sum("n").alias("dealt"), F.max("n").alias("most"))
        parted = (F.col("dealt") <= 3 * F.col("was")) & (F.col("most") <= 0.7 * F.col("was")) & F.lit(depth < rounds - 1)
        whole = whole.join(
            count.select("region", F.col("n").alias("was"), F.col("chars").alias("all_chars")), "region",
        ).select("region", "was", "all_chars", parted.alias("parted"))
        cells = graph.cut(cells.join(whole, "region").withColumn(
            "kind", F.when(F.col("parted"), F.col("kind")).otherwise("blocks"),
        ).select("region", "cell", "kind", "was", "all_chars"))
        kinds = {r[0] for r in cells.select("kind").distinct().collect()}
        dealt = dealt.join(graph.small(cells), ["region", "cell"])
        texts = rows.select(F.col("region").alias("_r"), F.col("doc_id").alias("_d"), "text")
        with_text = lambda df: df.join(texts, (df.region == F.col("_r")) & (df.doc_id == F.col("_d"))).drop("_r", "_d")
        named = F.xxhash64("region", "cell").alias("region")
        if "leaf" in kinds:
            held = with_text(dealt.where("kind = 'leaf'"))
            links.append(held.select(
                named, "doc_id", "text", F.lit(True).alias("probe"), F.lit(True).alias("within"),
            ).groupBy("region").applyInArrow(leaf, "a long, b long"))
        if "blocks" in kinds:
            # pivots don't part this region: the largest class of sets that links to pivots join is one already, all others are compared with everything
            mine = graph.cut(dealt.where("kind = 'blocks' and home").select("region", "doc_id", "was", "all_chars").distinct())
            held_by = graph.cut(graph.components(to_pivot).withColumnRenamed("node", "doc_id"))
            mine = mine.join(graph.small(held_by), "doc_id", "left")
            best = mine.where("component is not null").groupBy("region", "component").agg(F.count("*").alias("c")).groupBy("region").agg(F.max_by(
                "component", F.struct("c", "component"),
            ).alias("best"))
            mine = mine.join(graph.small(graph.cut(best)), "region", "left").withColumn(
                "free", ~F.coalesce(F.col("component") == F.col("best"), F.lit(False)),
            )
            frees = graph.cut(mine.groupBy("region").agg(F.count(F.when(F.col("free"), 1)).alias("n_free")))
            parts = F.greatest(F.ceil(F.col("was") * 2 / leaf_rows), F.ceil(F.col("all_chars") * 8 / leaf_bytes)).cast("int")
            mine = mine.join(graph.small(frees), "region").where("n_free > 0").withColumn("kx", parts).withColumn(
                "kb", F.ceil(F.col("kx") * F.col("n_free") / F.col("was")).cast("int"),
            )
            at = lambda k: F.pmod(F.xxhash64("doc_id"), F.col(k)).cast("int")
            every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
            left = with_text(mine)
            probes = left.where("free").select("region", at("kb").alias("i"), every("kx").alias("j"), "doc_id", "text", F.lit(True).alias("probe"))
            others = left.select("region", every("kb").alias("i"), at("kx").alias("j"), "doc_id", "text", F.lit(False).alias("probe"))
            links.append(probes.unionByName(others).withColumn(
                "within", F.lit(False),
            ).groupBy("region", "i", "j").applyInArrow(leaf, "a long, b long"))
        if "again" not in kinds:
            return links
        rows = graph.cut(with_text(dealt.where("kind = 'again'")).select(named, "doc_id", "text"))
    return links


def _parted(ids: DataFrame, leaf_rows: int, leaf_bytes: int) -> tuple[DataFrame, DataFrame, bool]:
    """Stored ids (node, doc_id, chars, region) of regions of several sets: those that fit a task, the larger ones, and whether there are any."""
    sized = ids.groupBy("region").agg(F.count("*").alias("n"), F.sum("chars").alias("all_chars"))
    sized = graph.cut(sized.where("n > 1").withColumn("big", (F.col("n") > leaf_rows) | (F.col("all_chars") * 4 > leaf_bytes)).select("region", "big"))
    marked = ids.join(graph.small(sized), "region").select("node", "doc_id", "chars", "region", "big")
    return graph.cut(marked.where("not big").drop("big")), graph.cut(marked.where("big").drop("big")), sized.where("big").limit(1).count() > 0


def jaccard_classes(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES,
) -> DataFrame:
    """Classes of documents linked by Jaccard similarity of their word n-gram sets, num/den or more.

    docs: doc_id (integer), text and any other columns, which are ignored. Texts fold ASCII capitals and split at blanks and
    \\x09-\\x0D; one of fewer than n words is one n-gram of all its words. Returns a row for each row of docs: doc_id,
    n_shingles, component_id (least doc_id of the class), digest (of the set; null if empty). A null or wordless text has
    n_shingles 0 and is alone; rows of equal sets share a class; rows that repeat a doc_id are kept. A row of null doc_id
    is returned with a null component_id and links nothing. An empty table gives no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sets = graph.cut(shingle_table(docs, n))
    known = sets.where("digest is not null and doc_id is not null")
    repeated = known.groupBy("doc_id").count().where("count > 1").limit(1).count() > 0
    distinct = known.groupBy("digest", "node").agg(F.min("doc_id").alias("rep"), F.max("chars").alias("chars"))
    in_region = lambda df: graph.cut(distinct.join(graph.small(graph.cut(df.withColumnRenamed("component", "region"))), "node").select("node", F.col("rep").alias("doc_id"), "chars", "region"))
    fit, rest, more = _parted(in_region(regions(docs.where("doc_id is not null"), n, num, den)), leaf_rows, leaf_bytes)
    if more:
        rest = graph.cut(texts_of(docs, linkable(docs, rest, repeated, n, num, den), repeated))
        again, rest, more = _parted(in_region(rare_regions(rest, n, num, den)), leaf_rows, leaf_bytes)
        fit = graph.cut(fit.unionByName(again))
    links = [texts_of(docs, fit, repeated).select(
        "region", "doc_id", "text", F.lit(True).alias("probe"), F.lit(True).alias("within"),
    ).groupBy("region").applyInArrow(_leaf_task(n, num, den), "a long, b long")]
    if more:
        links += _voronoi(graph.cut(texts_of(docs, rest, repeated)), n, num, den, leaf_rows, leaf_bytes)
    pairs = links[0]
    for x in links[1:]:
        pairs = pairs.unionByName(x)
    joined = graph.cut(graph.components(pairs))
    joined = joined.where("node <> component").select(F.col("node").alias("rep"), "component")
    of_rep = distinct.join(graph.small(joined), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    return sets.drop("node", "chars").join(of_rep, "digest", "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        "digest",
    )


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs without those whose class has a lesser doc_id; of rows that repeat a doc_id one stays. Rows of null doc_id stay."""
    cols = docs.columns
    cls = graph.cut(jaccard_classes(docs, n, num, den).where("doc_id is not null").groupBy("doc_id").agg(
        F.min("component_id").alias("c"), F.count("*").alias("copies"),
    ).where("c < doc_id or copies > 1"))
    out = docs.join(graph.small(cls.where("c < doc_id").select(F.col("doc_id").alias("_gone"))), F.col("doc_id") == F.col("_gone"), "left_anti")
    again = cls.where("c = doc_id and copies > 1").select(F.col("doc_id").alias("_again"))
    if again.limit(1).count():
        one = out.join(graph.small(again), F.col("doc_id") == F.col("_again")).dropDuplicates(["doc_id"]).select(cols)
        out = out.join(graph.small(again), F.col("doc_id") == F.col("_again"), "left_anti").unionByName(one)
    return out.select(cols)
