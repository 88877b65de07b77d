"""N-gram Jaccard join: candidates by partitioned signatures, then T-occurrence search with DivideSkip in blocks."""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, few_copies, forget, give_back, join_one, slices, table, written

#: Size classes of sets grow by this factor. It is over 1 / 0.85, so linked sets are in one class or the next.
GROWTH = 1.6
#: Signatures that a task sorts at a time, and bytes of text in one slice of a large block.
SIGNATURES, SLICE = 600_000, 8 << 20
#: Bytes of text whose words are held at a time.
TOGETHER = 1 << 20
#: Edges that a task replaces by a forest at a time.
EDGES = 200_000
#: Orders in which neighbours are compared before a search.
NEIGHBOURS = 8
#: Lower share of the hash space whose shingles tell which texts of a large block can have links.
PROBED = 0.3
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(32))) * ODD[3]
    x = (x ^ (x >> np.uint64(29))) * ODD[1]
    return x ^ (x >> np.uint64(32))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """For each text its distinct shingles of ``width`` words as sorted 64-bit numbers; fewer words make one shingle.

    Words are lists of small objects, many times their text's size: some texts are taken at a time.
    """
    out: list[np.ndarray] = []
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > TOGETHER:
            out += _shingle_sets(held, width)
            held, size = [], 0
    return out + _shingle_sets(held, width)


def _shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    flat: list[bytes] = []
    sizes = []
    for t in texts:
        words = t.lower().split()
        flat += words
        sizes.append(len(words))
    ids = np.fromiter(map(xxhash.xxh64_intdigest, flat), np.uint64, len(flat))
    rolled = np.zeros(max(0, len(ids) - width + 1), np.uint64)
    for k in range(width):
        rolled += mixed(ids[k : len(ids) - width + 1 + k] + ODD[4]) * (ODD[k % 5] + np.uint64(2 * k))
    rolled = mixed(rolled)
    out, at = [], 0
    for n in sizes:
        if n >= width:
            out.append(np.unique(rolled[at : at + n - width + 1]))
        elif n:  # the number of words tells it from longer shingles
            short = np.array([n], np.uint64)
            for k in range(n):
                short = mixed(short + ids[at + k : at + k + 1] * ODD[k % 5])
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
        at += n
    return out


def size_class(n: int) -> int:
    return int(math.log(n) / math.log(GROWTH) + 1e-9)


def class_parts(level: int, percent: int) -> tuple[int, int]:
    """How many parts the sets of a size class are cut into, and how many of them may be empty.

    Linked sets of sizes a, b up to n differ in at most (1 - t) / (1 + t) * (a + b) elements, t the threshold. With one
    part more than that, and those that may be empty, two linked sets have a part that is equal and not empty.
    """
    largest = math.ceil(GROWTH ** (level + 1))
    differ = (100 - percent) * 2 * largest // (100 + percent)
    empty = math.ceil(0.03 * differ) + 1
    return differ + 1 + empty, empty


def signatures(elements: np.ndarray, percent: int) -> np.ndarray:
    """One number for each part of a set of sorted elements, in its own size class and, near its upper end, in the next.

    A set with more empty parts than its class allows has signatures for them too, so that it meets its like.
    """
    n = len(elements)
    if not n:
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(elements))])
    out = []
    for level in {size_class(n), size_class(n * 100 // percent)}:
        parts, empty = class_parts(level, percent)
        cuts = np.searchsorted(elements, (np.arange(1, parts) * (2.0**64 / parts)).astype(np.uint64))
        cuts = np.concatenate([[0], cuts, [n]])
        held = np.diff(cuts) > 0
        salt = np.arange(parts, dtype=np.uint64) * ODD[0] + np.full(parts, level, np.uint64) * ODD[2]
        found = mixed((sums[cuts[1:]] - sums[cuts[:-1]]) + mixed(salt))
        out.append(found if parts - held.sum() > empty else found[held])
    return np.concatenate(out)


def _first_of_each(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with their least values, and the pairs (least value, other value) of a key."""
    order = np.lexsort((values, keys))
    keys, values = keys[order], values[order]
    first = np.append(True, keys[1:] != keys[:-1]) if len(keys) else np.empty(0, bool)
    least = np.repeat(values[first], np.diff(np.append(np.flatnonzero(first), len(keys))))
    other = values != least
    pairs = np.unique(np.column_stack([least[other], values[other]]), axis=0) if other.any() else np.empty((0, 2), values.dtype)
    return keys[first], values[first], pairs[:, 0], pairs[:, 1]


def candidate_edges(texts: DataFrame, width: int, percent: int, shingles: int) -> DataFrame:
    """(a, b): stars that join all texts (``node``) of which any share a signature; a superset of all links' ends.

    Texts that share a signature are joined to the least of them, first in each task, so that a signature that very
    many texts have leaves each task once, then after a shuffle by signature.
    """
    partitions = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(shingles * 0.4 / SIGNATURES))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes = [], []

        def out() -> Iterator[pa.RecordBatch]:
            found, least, a, b = _first_of_each(np.concatenate(keys), np.concatenate(nodes))
            keys.clear()
            nodes.clear()
            yield _rows(found.view(np.int64), least)
            yield _rows(None, a, b)

        for batch in slices(batches, "text", 4 << 20):
            batch = _first_rows(batch)
            sets = [signatures(s, percent) for s in shingle_sets(as_bytes(batch.column("text")), width)]
            keys.append(np.concatenate([*sets, np.empty(0, np.uint64)]))
            nodes.append(np.repeat(batch.column("node").to_numpy(), [len(s) for s in sets]))
            if sum(map(len, keys)) > SIGNATURES:
                yield from out()
        if keys:
            yield from out()

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(b.column("signature"), b.column("a").to_numpy(), b.column("b")) for b in batches]
        if not held:
            return
        made = [x.is_valid().to_numpy(zero_copy_only=False) for x, _, _ in held]
        keys = np.concatenate([x.drop_null().to_numpy() for x, _, _ in held])
        _, _, a, b = _first_of_each(keys, np.concatenate([y[m] for (_, y, _), m in zip(held, made, strict=True)]))
        old_a = np.concatenate([y[~m] for (_, y, _), m in zip(held, made, strict=True)])
        old_b = np.concatenate([z.drop_null().to_numpy() for _, _, z in held])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, old_a])), pa.array(np.concatenate([b, old_b]))], names=["a", "b"])

    rows = texts.select("node", "text").mapInArrow(star, "signature long, a long, b long")
    dealt = rows.repartition(partitions, F.coalesce("signature", F.xxhash64("a", "b")))
    return dealt.mapInArrow(across, "a long, b long").distinct()


def _first_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The first row of each text of a batch, so that copies do not meet by thousands."""
    nodes = batch.column("node").to_pylist()
    first = {n: i for i, n in reversed([*enumerate(nodes)])}
    return batch if len(first) == len(nodes) else batch.take(pa.array(sorted(first.values()), pa.int64()))


def can_be_linked(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(node): the texts whose links the counts of shared shingles leave possible.

    A linked text shares all but (100 - percent) % of its shingles with one other, so of the lower part of the hash
    space too it misses no more than that. Shingles that two texts of a task share are settled there, and leave it
    once; the others are counted after a shuffle.
    """
    top = np.uint64(int(PROBED * 2.0**64))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 8 << 20):
            batch = _first_rows(batch)
            sets = shingle_sets(as_bytes(batch.column("text")), width)
            low = [s[: np.searchsorted(s, top)] for s in sets]
            nodes = batch.column("node").to_numpy()
            sizes = np.array([len(x) for x in low], np.int64)
            every = np.concatenate([*low, np.empty(0, np.uint64)])
            found, back, counts = np.unique(every, return_inverse=True, return_counts=True)
            settled = counts[back] > 1
            here = np.bincount(np.repeat(np.arange(len(low)), sizes)[settled], minlength=len(low))
            allowed = np.array([len(s) * (100 - percent) // 100 for s in sets], np.int64)
            needed = sizes - allowed - here  # still to be found elsewhere
            yield _rows(None, nodes, needed)
            yield _rows(found[counts > 1].view(np.int64), np.zeros(int((counts > 1).sum()), np.int64))  # no b: some texts
            yield _rows(every[~settled].view(np.int64), np.repeat(nodes, sizes)[~settled], np.ones(int((~settled).sum()), np.int64))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, real = [], [], []
        for b in batches:
            counted = b.column("signature").is_null().to_numpy(zero_copy_only=False)
            if counted.any():
                kept = b.filter(pa.array(counted))
                yield pa.RecordBatch.from_arrays([kept.column("a"), kept.column("b"), pa.array(np.zeros(kept.num_rows, np.int64))], names=["node", "needed", "got"])
            b = b.filter(pa.array(~counted))
            keys.append(b.column("signature").to_numpy())
            nodes.append(b.column("a").to_numpy())
            real.append(b.column("b").is_valid().to_numpy(zero_copy_only=False))
        if keys:
            key, node, own = np.concatenate(keys), np.concatenate(nodes), np.concatenate(real)
            order = np.lexsort((node, ~own, key))
            key, node, own = key[order], node[order], own[order]
            _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
            # A text that came in several batches is there as often; only other texts' rows count for it.
            fresh = np.append(True, (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | ~own[1:])
            others = np.bincount(back, weights=fresh, minlength=len(counts))
            hit = node[own & fresh & (others[back] > 1)]
            # A row for each shingle found: as many as the input has, however many tasks; they are summed before the shuffle.
            for at in range(0, len(hit), 200_000):
                part = hit[at : at + 200_000]
                yield pa.RecordBatch.from_arrays([pa.array(part), pa.nulls(len(part), pa.int64()), pa.array(np.ones(len(part), np.int64))], names=["node", "needed", "got"])

    rows = texts.select("node", "text").mapInArrow(probe, "signature long, a long, b long")
    dealt = rows.repartition(F.coalesce("signature", F.xxhash64("a")))
    # A text that came in several batches may be counted more than once, which leaves it possible.
    sums = dealt.mapInArrow(across, "node long, needed long, got long").groupBy("node").agg(F.min("needed").alias("needed"), F.sum("got").alias("got"))
    return sums.where(F.col("needed") <= F.col("got")).select("node")


def rare_edges(texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): stars that join all texts (``node``) of which any share one of their rarest shingles.

    Ordered by how many texts hold them, the first n - ceil(t * n) + 1 shingles of two linked sets have one in common.
    Shingles that one text holds come first and join nothing; those that very many hold come last, so that passages
    that many texts share hang nothing together. ``texts`` has each text once.
    """

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            sets = shingle_sets(as_bytes(batch.column("text")), width)
            sizes = np.array([len(s) for s in sets], np.int64)
            every = np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(every), pa.array(np.repeat(batch.column("node").to_numpy(), sizes)), pa.array(np.repeat(sizes, sizes))], names=["element", "node", "n"])

    rows = texts.select("node", "text").mapInArrow(elements, "element long, node long, n long")
    shared = rows.groupBy("element").agg(F.count("*").alias("df")).where(F.col("df") > 1)
    own = Window.partitionBy("node")
    ranked = rows.join(shared, "element").withColumn("place", F.row_number().over(own.orderBy("df", "element"))).withColumn("c", F.count("*").over(own))
    first = ranked.where(F.col("place") <= F.col("c") - F.ceil(F.lit(percent) * F.col("n") / 100) + 1).select("element", "node")
    first = written(first, "rare-shingles")
    least = first.groupBy("element").agg(F.min("node").alias("a"))
    return first.join(least, "element").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b")).distinct()


def _rows(signature: np.ndarray | None, a: np.ndarray, b: np.ndarray | None = None) -> pa.RecordBatch:
    none = pa.nulls(len(a), pa.int64())
    return pa.RecordBatch.from_arrays([none if signature is None else pa.array(signature), pa.array(a), none if b is None else pa.array(b)], names=["signature", "a", "b"])


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A forest (a, b) with the same components as the edges (u, v), some 200,000 of them at a time: an edge fewer than nodes at most."""
    held: list[pa.RecordBatch] = []

    def out() -> Iterator[pa.RecordBatch]:
        coded = pa.concat_arrays([b.column(c) for c in ("u", "v") for b in held]).dictionary_encode()
        codes, n = coded.indices.to_numpy().tolist(), len(coded) // 2
        groups = Groups(len(coded.dictionary))
        for a, b in zip(codes[:n], codes[n:], strict=True):
            groups.join(a, b)
        held.clear()
        roots = np.array([groups.find(k) for k in range(len(groups.root))], np.int64)
        other = np.flatnonzero(roots != np.arange(len(roots)))
        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(roots[other])), coded.dictionary.take(pa.array(other))], names=["a", "b"])

    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) > EDGES:
            yield from out()
    if held:
        yield from out()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (a, b): the least node that each reaches, for all nodes with an edge.

    Edges inside one family may be as many as its pairs: tasks first replace theirs by a forest, EDGES at a time, so that
    what is joined grows with the nodes.

    Alternating large and small stars: each round hangs every node's neighbours on the least of them, by sums and
    joins on nodes, so that a node with very many neighbours is summed in parts and joined where its edges are. Rounds
    are written, and dropped when the next one is; their number grows as the logarithm of the size.
    """
    edges = written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    kind = edges.schema["u"].dataType.simpleString()
    parts = edges.count() // EDGES + 1
    trees = edges.repartition(parts).mapInArrow(spanning, f"a {kind}, b {kind}")
    whole, edges = edges, written(trees.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "trees")
    forget(whole)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("w"))
        large = join_one(both, least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("w").alias("v"))
        large = written(large.where(F.col("u") != F.col("v")).distinct(), "large-stars")
        forget(edges)
        least = large.groupBy("u").agg(F.min("v").alias("w"))
        small = join_one(large, least, "u")
        small = small.select(F.col("v").alias("u"), F.col("w").alias("v")).unionByName(least.select("u", F.col("w").alias("v")))
        edges = written(small.where(F.col("u") != F.col("v")).distinct(), "small-stars")
        forget(large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


class Index:
    """Inverted lists, sorted, of the elements that at least ``owners`` sets hold."""

    def __init__(self, sets: list[np.ndarray], owners: int) -> None:
        self.sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate([*sets, np.empty(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        every, self.owners = every[order], owner[order]
        elements, starts, counts = np.unique(every, return_index=True, return_counts=True)
        held = counts >= owners
        self.elements, self.starts, self.ends = elements[held], starts[held], (starts + counts)[held]

    def lists(self, elements: np.ndarray) -> list[np.ndarray]:
        at = np.searchsorted(self.elements, elements)
        at[at == len(self.elements)] = 0
        at = at[self.elements[at] == elements] if len(self.elements) else at[:0]
        return [self.owners[a:z] for a, z in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]


def merge(lists: list[np.ndarray], least: int) -> list[tuple[int, int]]:
    """Set numbers that stand in at least ``least`` of the sorted lists, with how often: a heap of the lists' heads.

    When fewer than ``least`` heads are left the merge ends; heads that cannot reach ``least`` are skipped to the next
    that can.
    """
    if len(lists) < least:
        return []
    flat = [x.tolist() for x in lists]
    heads = [(x[0], k, 0) for k, x in enumerate(flat)]
    heapq.heapify(heads)
    pop, push = heapq.heappop, heapq.heappush
    out = []
    while len(heads) >= least:
        doc = heads[0][0]
        popped = []
        while heads and heads[0][0] == doc:
            popped.append(pop(heads))
        if len(popped) >= least:
            out.append((doc, len(popped)))
            target = doc + 1
        else:  # take more heads, up to one less than needed; what the next head lies before cannot reach it
            while heads and len(popped) < least - 1:
                popped.append(pop(heads))
            if not heads:
                break
            target = heads[0][0]
        for _, k, at in popped:
            x = flat[k]
            at = bisect_left(x, target, at)
            if at < len(x):
                push(heads, (x[at], k, at))
    return out


def search(index: Index, elements: np.ndarray, percent: int, skip, before: int | None = None) -> Iterator[int]:  # noqa: ANN001
    """DivideSkip: numbers of the index's sets that are linked with ``elements``, but those that ``skip`` tells to.

    Sets are numbered by size. Those from percent of the query's size to its size over percent can be linked, and only
    their parts of the lists (and those ``before`` a number) are read; the smallest of them needs the least overlap T.
    As many of the longest lists as pays are set aside; the short ones are merged with what is left of T, and the
    candidates looked up in the long ones by binary search, until T cannot be reached any more.
    """
    n = len(elements)
    low, high = -(-n * percent // 100), n * 100 // percent
    first, last = np.searchsorted(index.sizes, [low, high + 1]).tolist()
    last = last if before is None else min(last, before)
    if first >= last:
        return
    needed = -(-percent * (n + int(index.sizes[first])) // (100 + percent))
    lists = index.lists(elements)
    if len(lists) < needed:
        return
    lists = [x for x in (y[np.searchsorted(y, first) : np.searchsorted(y, last)] for y in lists) if len(x)]
    if len(lists) < needed:
        return
    lists.sort(key=len)
    longest = len(lists[-1])
    aside = min(needed - 1, len(lists), int(needed / (0.0085 * math.log2(longest + 1) + 1)))
    short, long = lists[: len(lists) - aside], lists[len(lists) - aside :]
    found = [(d, c) for d, c in merge(short, needed - aside) if not skip(d)]
    docs, counts = np.array([d for d, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    sizes = index.sizes[docs]
    want = -(-percent * (n + sizes) // (100 + percent))
    for k, x in enumerate(long):  # all candidates are looked up in a list at once
        held = counts + len(long) - k >= want
        if not held.all():
            docs, counts, sizes, want = docs[held], counts[held], sizes[held], want[held]
        if not len(docs):
            return
        at = np.searchsorted(x, docs)
        at[at == len(x)] = 0
        counts = counts + (x[at] == docs)
    yield from docs[100 * counts >= percent * (n + sizes - counts)].tolist()


class Groups:
    """Sets that links join, by their least numbers."""

    def __init__(self, n: int) -> None:
        self.root = list(range(n))

    def find(self, k: int) -> int:
        root = self.root
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        self.root[max(a, b)] = min(a, b)


def _neighbours_joined(sets: list[np.ndarray], percent: int, groups: Groups) -> None:
    """Join sets that are linked and neighbours when ordered by their first element from some place on.

    Families of sets that are alike are mostly joined so, at little cost; the search then needs to look for links
    between groups only.
    """
    order = [k for k in range(len(sets)) if len(sets[k])]
    for part in range(NEIGHBOURS):
        start = np.uint64(part * (2.0**64 / NEIGHBOURS))
        at = {k: int(np.searchsorted(sets[k], start)) for k in order}
        key = {k: int(sets[k][i]) if i < len(sets[k]) else -1 for k, i in at.items()}
        ranked = sorted(order, key=lambda k: (key[k], len(sets[k]), k))
        for a, b in zip(ranked, ranked[1:], strict=False):
            if key[a] != key[b] or groups.find(a) == groups.find(b):
                continue
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = np.concatenate([x, y])
            both.sort()
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            if 100 * shared >= percent * (len(x) + len(y) - shared):
                groups.join(a, b)


def linked(sets: list[np.ndarray], percent: int, left: list[bool] | None = None) -> list[int]:
    """For each set the least number of its component, numbers as given. With ``left``, only links across are looked for.

    Neighbours are joined first. Of two groups it is enough that the sets of one look for links with the other, so the
    sets of the largest group are looked up by all others and look for nothing themselves (with ``left``: for sets
    outside it only). Sets that are already in one group are not compared any more.
    """
    order = sorted((k for k in range(len(sets)) if len(sets[k])), key=lambda k: (len(sets[k]), k))
    groups = Groups(len(sets))
    _neighbours_joined(sets, percent, groups)
    weight: dict[int, int] = {}
    for k in order:
        weight[groups.find(k)] = weight.get(groups.find(k), 0) + len(sets[k])
    most = max(weight, key=lambda k: (weight[k], -k), default=-1)
    held = {k: groups.find(k) == most for k in order}
    inside = [k for k in order if left is None or left[k]]
    known, rest = [k for k in inside if held[k]], [k for k in inside if not held[k]]
    by_known, by_rest = Index([sets[k] for k in known], 1), Index([sets[k] for k in rest], 1)
    place = {k: i for i, k in enumerate(rest)}
    for k in order if left is None else [k for k in order if not left[k]]:
        if held[k] and left is None:
            continue
        for numbers, index, before in ((rest, by_rest, place.get(k)), *([] if held[k] else [(known, by_known, None)])):
            for doc in search(index, sets[k], percent, lambda d, k=k, numbers=numbers: groups.find(numbers[d]) == groups.find(k), before):
                groups.join(numbers[doc], k)
    return [groups.find(k) for k in range(len(sets))]


def jaccard_components(df: DataFrame, width: int = 5, percent: int = 80, text: str = "text", keep: list[str] | None = None, slice_bytes: int = SLICE) -> DataFrame:
    """``df`` (or its columns ``keep``) with n_shingles (long) and ``component`` (binary): rows with one component are joined by links.

    Two texts link when 100 * intersection >= percent * union of their sets of distinct shingles of ``width`` words
    (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased). Fewer words than ``width`` make one shingle of all; no words or null
    make none and link with nothing, not even with each other: their component is null.

    Equal texts are one node, whatever their number. Nodes that share a signature form blocks, in which every link
    outside components already found is searched; a text is read whole. A block of more than ``slice_bytes`` of text
    is dealt into slices, and each two slices are searched in a task of their own, so that memory is bounded; their
    findings are joined by components again. Shingles are compared as 64-bit numbers. Repeated rows and ties need
    nothing special. No rows give no rows. Input columns named n_shingles or component are replaced.
    """
    own = [c for c in (df.columns if keep is None else keep) if c not in ("n_shingles", "component")]
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in own]).alias("row"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("key", F.unhex(F.md5("text")))
    node = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long").alias("node")
    schema = f"row {rows.schema['row'].dataType.simpleString()}, key binary, bytes long, n_shingles long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = as_bytes(batch.column("text"))
            sizes = [len(s) for s in shingle_sets(texts, width)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("key"), pa.array([len(t) for t in texts], pa.int64()), pa.array(sizes, pa.int64())], names=["row", "key", "bytes", "n_shingles"])

    counted = written(rows.mapInArrow(count, schema), "shingle-counts")

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first of equal texts of a batch, so that copies do not meet by thousands."""
        for batch in batches:
            keys = batch.column("key").to_pylist()
            yield batch.take(pa.array(sorted({k: i for i, k in reversed([*enumerate(keys)])}.values()), pa.int64()))

    plain = [F.col(f"row.`{f.name}`") for f in rows.schema["row"].dataType if "map<" not in f.dataType.simpleString()]
    by = F.xxhash64(*plain) if plain else F.lit(0).cast("long")
    texts = few_copies(rows.select(node, "key", "text", by.alias("by")), "key", [F.col("by")]).select("node", "key", "text")
    total = counted.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]

    def of(nodes: DataFrame) -> DataFrame:
        """The texts of some nodes, which go to every task while they are few (some 10 MB)."""
        return texts.join(F.broadcast(nodes) if nodes.count() <= 200_000 else nodes, "node")

    def blocks_of(edges: DataFrame) -> DataFrame:
        roots = written(components(edges), "roots")
        sizes = counted.select(node, "key", "bytes").distinct().join(roots, "node").groupBy("root").agg(F.ceil(F.sum("bytes") / slice_bytes).cast("int").alias("parts"))
        found = written(join_one(roots, sizes, "root"), "blocks")
        forget(roots)
        return found

    blocks = blocks_of(candidate_edges(texts, width, percent, total))
    large = blocks.where(F.col("parts") > 1).select("node")
    if large.limit(1).count():
        # Passages that many texts share may hang whole blocks together. Texts that cannot be linked leave them; the
        # others are joined anew by their rarest shingles.
        possible = written(can_be_linked(of(large), width, percent), "possible")
        once_each = written(of(possible).dropDuplicates(["key"]), "possible-texts")
        blocks = blocks.where(F.col("parts") == 1).unionByName(blocks_of(rare_edges(once_each, width, percent)))
    members = of(blocks).select("key", "text", "root", "parts").mapInArrow(once, "key binary, text string, root long, parts int")
    mine = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    members = members.select("root", "key", "text", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    members = members.select("root", "key", "text", "mine", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"))

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("key").sort_values("key", ignore_index=True)
        sets = shingle_sets([t.encode() for t in pdf["text"]], width)
        across = pdf["one"].iloc[0] != pdf["two"].iloc[0]
        root = linked(sets, percent, (pdf["mine"] == pdf["one"]).tolist() if across else None)
        keys = pdf["key"].tolist()
        found = [(keys[r], keys[k]) for k, r in enumerate(root) if r != k]
        if sum(map(len, sets)) > 100_000:
            del sets
            give_back()
        return pd.DataFrame({"a": [a for a, _ in found], "b": [b for _, b in found]}, dtype=object)

    stars = members.groupBy("root", "one", "two").applyInPandas(block, "a binary, b binary")
    found = components(stars).select(F.col("node").alias("key"), F.col("root").alias("component"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "key"))
    return join_one(counted, written(found, "components"), "key", "left").select("row.*", "n_shingles", component.alias("component"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with 4-word shingles at 0.85. A document without words is its own component."""
    found = written(jaccard_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, 85, keep=["doc_id"]), "linked")
    least = found.where(F.col("component").isNotNull()).groupBy("component").agg(F.min("doc_id").alias("component_id"))
    joined = join_one(found, least, "component", "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 3), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM c JOIN n na ON na.doc_id = x JOIN n nb ON nb.doc_id = y WHERE 100 * i >= 85 * (na.n + nb.n - i)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x),
m AS (SELECT a, min(b) AS b FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.b AS component_id FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.a = d.doc_id
"""
