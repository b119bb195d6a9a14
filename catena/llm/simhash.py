"""Near duplicates by SimHash fingerprints, joined through vantage-point trees.

A vantage-point tree halves a set of fingerprints by their Hamming distance to one
of them.  Two fingerprints within ``radius`` bits have one between them within
half the radius of both; by the triangle inequality, if every fingerprint goes down
each branch that comes within half the radius of it, both reach the leaf where
the one between would lie.  So fingerprints near a boundary go to both sides,
all others to one, and every pair within ``radius`` meets in some leaf.

The top of the tree is grown on a bounded sample and deals all distinct fingerprints to
shards; each shard grows its own tree further and compares its leaves exactly.
A leaf that no vantage point can halve (many fingerprints in a small ball) is
joined through its fingerprints' neighbours at half the radius, which takes time
in proportion to its size.  Shards return links to the smallest fingerprint of
each group they find, so links stay fewer than the rows dealt out.

``keep_one`` drops near copies by similarity: texts whose sets of five-word shingles have a Jaccard similarity of 4/5 or
more.  At that similarity single fingerprints differ by ten bits, beyond what trees can search, so it takes a
fingerprint of 256 bits and joins sixteen parts of 32 bits of it (each bit is in two) through trees of their own, each exactly within two bits.
In a shard the whole fingerprints of what meets are compared, and the shortest links that connect it (at most one a
row) are returned; these are decided by the shingles themselves.

Fingerprints miss some pairs near 4/5, so an exact step follows for pairs of texts that are not in one group yet: two sets
of that similarity share one of their first shingles (a fifth of each set and one more) in any order that all texts keep.
Texts meet at these only where what follows in both sets leaves 4/5 within reach; what meets is decided by the shingles, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.llm import base
from catena.operators.graph import components

RADIUS = 2
SHINGLE = 3
SEED = 42
#: Fingerprints that a shard aims at, and those on which the top of the tree is grown at most (8 bytes each).
SHARD = 4_000
SAMPLE = 1_000_000
LEAF = 256


def _lanes() -> np.ndarray:
    """For each byte a word of 8 bytes, one for each of its bits."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view(np.uint64)[:, 0]


_LANES = _lanes()


def majority(hashes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bits set in over half the hashes of each run; 0 for an empty run."""
    n = np.diff(offsets)
    # Bytes count to 255, so runs are summed in chunks of at most 255 hashes.
    chunks = -(-n // 255)
    starts = base.spread(np.zeros(len(n), dtype=np.int64), chunks) * 255 + np.repeat(offsets[:-1], chunks)
    first = np.concatenate([[0], np.cumsum(chunks)])
    by_byte = np.ascontiguousarray(hashes.astype(">u8")).view(np.uint8).reshape(-1, 8)
    out = np.zeros((len(n), 64), dtype=np.uint8)
    some = np.flatnonzero(n)
    if len(some):
        for k in range(8):
            sums = np.add.reduceat(_LANES[by_byte[:, k]], starts)
            counts = sums.view(np.uint8).reshape(-1, 8).astype(np.int64)
            total = np.add.reduceat(counts, first[:-1][some], axis=0)
            out[some, 8 * k : 8 * k + 8] = 2 * total > n[some, None]
    return np.packbits(out, axis=1).view(">u8")[:, 0].astype(np.uint64)


def shingles(data: bytes, length: int) -> list[bytes]:
    """Runs of ``length`` words, joined by spaces; a shorter text is one run."""
    words = data.lower().split()
    if len(words) <= length:
        return [b" ".join(words)] if words else []
    return [b" ".join(x) for x in zip(*(words[i:] for i in range(length)), strict=False)]


def fingerprints(docs: DataFrame, length: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``doc_id, fingerprint`` (the 64 bits as a long) of every whole text; no words give 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = xxhash.xxh64_intdigest
        for whole in batches:
            for batch in base.slices(whole):
                hashes, size = [], []
                for data in batch.column("text").cast(pa.binary()).to_pylist():
                    found = [h(s, seed) for s in shingles(data, length)]
                    hashes.append(np.array(found, dtype=np.uint64))
                    size.append(len(found))
                prints = majority(np.concatenate(hashes), np.concatenate([[0], np.cumsum(size)]).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fingerprint"])

    rows = base.whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.mapInArrow(base.trimmed(run), "doc_id long, fingerprint long")


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


def halve(points: np.ndarray, tries: int = 8) -> tuple[np.uint64, int] | None:
    """A vantage point and a distance: up to it lies the inner half, beyond it the outer.

    Of a few evenly spaced candidates the one is taken that sends fewest rows to both sides; None if no one halves.
    """
    best = None
    for vantage in points[:: max(1, len(points) // tries)][:tries]:
        d = distance(points, vantage)
        count = np.cumsum(np.bincount(d, minlength=66))
        middle = int(np.searchsorted(count, len(points) / 2))
        for cut in (middle - 1, middle):
            if cut < 0:
                continue
            inner, outer = int((d <= cut + RADIUS // 2).sum()), int((d > cut - RADIUS // 2).sum())
            if max(inner, outer) <= 0.9 * len(points) and (best is None or inner + outer < best[0]):
                best = (inner + outer, vantage, cut)
    return None if best is None else best[1:]


def sides(points: np.ndarray, vantage: np.uint64, cut: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which points come within ``reach`` of the inner, and of the outer side."""
    d = distance(points, vantage)
    return d <= cut + reach, d > cut - reach


def grow(points: np.ndarray, leaf: int) -> list:
    """The tree as nested lists: [vantage, cut, inner, outer], or [] for a leaf."""
    if len(points) <= leaf or (split := halve(points)) is None:
        return []
    d = distance(points, split[0])
    return [int(split[0]), split[1], grow(points[d <= split[1]], leaf), grow(points[d > split[1]], leaf)]


def deal(points: np.ndarray, tree: list, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(index, leaf) for every leaf that each point reaches; leaves are numbered from the left."""
    found, leaves, number = [], [], 0
    todo = [(tree, np.arange(len(points)))]
    while todo:
        node, own = todo.pop()
        if not node:
            found.append(own)
            leaves.append(np.full(len(own), number))
            number += 1
            continue
        inner, outer = sides(points[own], np.uint64(node[0]), node[1], reach)
        todo += [(node[3], own[outer]), (node[2], own[inner])]
    return np.concatenate(found), np.concatenate(leaves)


class Forest:
    """Groups of positions, by the smallest."""

    def __init__(self, n: int) -> None:
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join pairs of positions: roots move to the smaller one until nothing changes."""
        while len(a):
            ra, rb = self.find(a), self.find(b)
            low, high = np.minimum(ra, rb), np.maximum(ra, rb)
            apart = low != high
            if not apart.any():
                return
            a, b, low, high = a[apart], b[apart], low[apart], high[apart]
            np.minimum.at(self.root, high, low)

    def find(self, x: np.ndarray) -> np.ndarray:
        while True:
            up = self.root[self.root[x]]
            if (up == self.root[x]).all():
                return up
            self.root[x] = up


def link_leaf(points: np.ndarray, own: np.ndarray, radius: int, forest: Forest) -> None:
    """Compare all of a small leaf, a block of rows at a time."""
    p = points[own]
    for lo in range(0, len(p), 512):
        a, b = np.nonzero(np.bitwise_count(p[lo : lo + 512, None] ^ p[None, :]) <= radius)
        forest.link(own[a + lo], own[b])


def link_ball(points: np.ndarray, own: np.ndarray, radius: int, forest: Forest) -> None:
    """Join points through what lies within half the radius of both: exact, in linear time."""
    near = radius // 2
    masks = [0] + [sum(1 << b for b in bits) for k in range(1, near + 1) for bits in combinations(range(64), k)]
    if radius % 2:
        raise ValueError("the radius is even")
    # A neighbourhood is visited in 16 parts by its low bits, to hold memory down.
    for part in range(16):
        keys, who = [], []
        for mask in masks:
            k = points[own] ^ np.uint64(mask)
            hit = np.flatnonzero((base.mix(k) & np.uint64(15)) == part)
            keys.append(k[hit])
            who.append(own[hit])
        key, pos = np.concatenate(keys), np.concatenate(who)
        order = np.argsort(key, kind="stable")
        key, pos = key[order], pos[order]
        same = key[1:] == key[:-1]
        forest.link(pos[1:][same], pos[:-1][same])


def link_shard(points: np.ndarray, radius: int = RADIUS, leaf: int = LEAF) -> np.ndarray:
    """The position of the first point of each point's group within a shard."""
    forest = Forest(len(points))
    todo = [np.arange(len(points))]
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            link_leaf(points, own, radius, forest)
        elif (split := halve(points[own])) is None:
            link_ball(points, own, radius, forest)
        else:
            todo += [own[s] for s in sides(points[own], *split, radius // 2)]
    return forest.find(np.arange(len(points)))


def links(prints: DataFrame, radius: int = RADIUS, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """``a, b``: links that join all distinct fingerprints within ``radius`` bits, from ``fingerprint``.

    The sample has 64 fingerprints for each shard, up to ``sample``; beyond
    ``shard * sample / 64`` fingerprints there are no more shards and they grow.  A ball that no vantage point halves is not
    left to one task: its fingerprints meet at their neighbours, which are dealt out.
    """
    n = prints.count()
    size = min(sample, 64 * n // shard) if n > shard else 0
    leaf = max(64, size * shard // max(n, 1))
    few = base.sample(prints.select("fingerprint"), n, size, "fingerprint")
    points = np.array([r[0] for r in few.collect()], dtype=np.int64).view(np.uint64)
    tree = grow(points, leaf)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("fingerprint"), dtype=np.int64)
            which, at = deal(own.view(np.uint64), tree, radius // 2)
            yield pa.RecordBatch.from_arrays([pa.array(own[which]), pa.array(at.astype(np.int64))], names=["fingerprint", "shard"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        own = np.sort(rows["fingerprint"].to_numpy())
        first = own[link_shard(own.view(np.uint64), radius)]
        apart = first != own
        return pd.DataFrame({"a": own[apart], "b": first[apart]})

    dealt = prints.select("fingerprint").mapInArrow(base.trimmed(route), "fingerprint long, shard long")
    balls = _balls(points, tree, leaf)
    if not balls:
        return dealt.groupBy("shard").applyInPandas(join, "a long, b long")
    apart = dealt.where(~F.col("shard").isin(balls)).groupBy("shard").applyInPandas(join, "a long, b long")
    return apart.unionByName(_ball_links(dealt.where(F.col("shard").isin(balls)).select("fingerprint").distinct(), radius))


def _balls(points: np.ndarray, tree: list, leaf: int) -> list[int]:
    """Leaves with many times their share of the sample: no vantage point halves them."""
    _, at = deal(points, tree, 0)
    return np.flatnonzero(np.bincount(at, minlength=1) > 4 * leaf).tolist()


def _ball_links(prints: DataFrame, radius: int) -> DataFrame:
    """``a, b`` within a ball of any size: two fingerprints are near exactly if they share a neighbour at half the radius.

    Each goes to all its neighbours; of what meets there the smallest links to the others, by a minimum that combines before the shuffle.
    """
    masks = [np.uint64(sum(1 << b for b in bits)).astype(np.int64) for k in range(radius // 2 + 1) for bits in combinations(range(64), k)]
    keyed = prints.select("fingerprint", F.explode(F.array(*[F.col("fingerprint").bitwiseXOR(F.lit(int(m))) for m in masks])).alias("key"))
    low = keyed.groupBy("key").agg(F.min("fingerprint").alias("low"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(low, "key").where("fingerprint <> low").select(F.col("fingerprint").alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, length: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    Fingerprints are taken of whole texts, however long; they link at ``radius`` or fewer differing bits, and the id of a
    component is its smallest doc_id.  Null and empty texts have fingerprint 0,
    which links like any other.  Rows without a doc_id are linked but name no component unless all rows of it lack one;
    rows that repeat a doc_id are all returned.  Other columns are ignored; an
    empty table gives an empty result.
    """
    prints = base.store(fingerprints(docs, length), "fingerprints")
    distinct = base.store(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("low")), "distinct-fingerprints")
    found = base.store(links(distinct, radius), "links")
    roots = components(found)
    named = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = base.store(named.join(lowest, "root").select("fingerprint", "component_id"), "components")
    hexed = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return prints.join(named, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id")


#: Words of a shingle where similarity decides; 64-bit lanes of a wide fingerprint; its parts that have trees, 32 bits each.
WORDS, LANES, TABLES = 5, 4, 16
#: Rows that a shard of wide fingerprints aims at: they are small, and fewer shards have less at their boundaries.
WIDE_SHARD = 64_000
#: Differing bits of 256 up to which a pair is looked at (4/5 of similarity means 39, with a deviation of 6), and up to which it is surely near.
NEAR, SURE = 64, 24
#: Rows of a ball (points that no vantage point halves) that are compared all with all; leaders of a ball that the driver picks at most.
BALL, LEADERS = 4096, 64
WIDE = [f"w{i}" for i in range(LANES)]
#: Text whose shingles are held at once.
SET_BYTES = 2 << 20
#: Text a task whose first shingles meet.
MEET_BYTES = 12 << 20
#: Keys (8 bytes each) that are broadcast once they were counted, so that texts stay where they are; more are joined by shuffling the texts.
BROADCAST_KEYS = 500_000


def shingle_sets(texts: pa.Array, length: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of each text's distinct shingles, and these as sorted 64-bit hashes.

    Words are compared in ASCII lower case.  A shorter text is one shingle, and so is a text without words.
    """
    offsets, codes, distinct = base.coded_words(pc.ascii_lower(texts))
    words = np.append(base.word_hashes(distinct)[codes], np.uint64(0))
    size = np.diff(offsets)
    count = np.maximum(size - length + 1, 1)
    at = base.spread(offsets[:-1], count)
    text = np.repeat(np.arange(len(size)), count)
    end = offsets[1:][text]
    found = np.zeros(len(at), dtype=np.uint64)
    for j in range(length):
        inside = at + j < end
        found = np.where(inside, base.mix(found + words[np.where(inside, at + j, 0)] + np.uint64(1)), found)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), dtype=bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    return np.concatenate([[0], np.cumsum(np.bincount(text[new], minlength=len(size)))]).astype(np.int64), found[new]


def _keyed(docs: DataFrame) -> DataFrame:
    """``doc_id, key, text``: equal texts (null: empty) have one key, a 64-bit hash."""
    rows = base.whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.select("doc_id", F.xxhash64("text").alias("key"), "text")


def wide_prints(rows: DataFrame) -> DataFrame:
    """``key`` and the lanes of the wide fingerprint of every ``key, text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.slices(whole, limit=SET_BYTES):
                offsets, found = shingle_sets(batch.column("text"))
                lanes = [majority(base.mix(found + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)), offsets) for i in range(LANES)]
                yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x.view(np.int64)) for x in lanes)], names=["key", *WIDE])

    return rows.select("key", "text").mapInArrow(base.trimmed(run), "key long, " + ", ".join(f"{w} long" for w in WIDE))


def part_of(wide: np.ndarray, table: int) -> np.ndarray:
    """The 32 bits of a table: half a lane, or from the ninth on a byte of each lane."""
    if table < 2 * LANES:
        return (wide[:, table // 2] >> np.uint64(32 * (table % 2))) & np.uint64(0xFFFFFFFF)
    out = np.zeros(len(wide), dtype=np.uint64)
    for lane in range(LANES):
        byte = (wide[:, lane] >> np.uint64(8 * ((table + 3 * lane) % 8))) & np.uint64(0xFF)
        out |= byte << np.uint64(8 * lane)
    return out


def wide_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64).sum(axis=-1)


def tree_edges(n: int, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Which of the edges a - b of length d make up the shortest forest over n points (Boruvka's rounds)."""
    forest, index, chosen = Forest(n), np.arange(len(a)), []
    while len(index):
        ra, rb = forest.find(a[index]), forest.find(b[index])
        apart = ra != rb
        index, ra, rb = index[apart], ra[apart], rb[apart]
        rank = (d[index] << 40) + index
        best = np.full(n, np.iinfo(np.int64).max)
        np.minimum.at(best, ra, rank)
        np.minimum.at(best, rb, rank)
        pick = np.unique(best[best < np.iinfo(np.int64).max]) & ((1 << 40) - 1)
        chosen.append(pick)
        forest.link(a[pick], b[pick])
    return np.concatenate(chosen) if chosen else np.zeros(0, dtype=np.int64)


def gather(wide: np.ndarray, most: int) -> tuple[list[int], np.ndarray]:
    """Leaders, each the first point that is not surely near one before it, at most ``most``; and each point's leader (-1: none)."""
    leaders, of, left = [], np.full(len(wide), -1), np.arange(len(wide))
    while len(left) and len(leaders) < most:
        near = wide_distance(wide[left], wide[left[0]]) <= SURE
        leaders.append(int(left[0]))
        of[left[near]] = left[0]
        left = left[~near]
    return leaders, of


def _near_pairs(part: np.ndarray, wide: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of points within two bits of their part that are near as a whole, and their distances, a block of rows at a time."""
    out = []
    for lo in range(0, len(part), 256):
        a, b = np.nonzero(np.bitwise_count(part[lo : lo + 256, None] ^ part[None, lo:]) <= RADIUS)
        a, b = a[a < b] + lo, b[a < b] + lo
        d = wide_distance(wide[a], wide[b])
        out.append((a[d <= NEAR], b[d <= NEAR], d[d <= NEAR]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def shard_edges(part: np.ndarray, wide: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray]:
    """Links within a shard: for each leaf of its tree the shortest forest over pairs that are near.

    Of a ball with more points than are compared all with all, points that are surely near a leader link to it alone.
    """
    links, todo = [np.zeros((2, 0), dtype=np.int64)], [np.arange(len(part))]
    while todo:
        own = todo.pop()
        if len(own) > leaf and (split := halve(part[own])) is not None:
            todo += [own[s] for s in sides(part[own], *split, RADIUS // 2)]
            continue
        if len(own) > BALL:
            leaders, of = gather(wide[own], BALL)
            led = np.flatnonzero((of >= 0) & (of != np.arange(len(own))))
            links.append(np.stack([own[led], own[of[led]]]))
            # Leaders go on, and what has none, by shards that may be large again: blocks hold memory down.
            own = own[np.union1d(leaders, np.flatnonzero(of < 0))]
        a, b, d = _near_pairs(part[own], wide[own])
        keep = tree_edges(len(own), a, b, d)
        links.append(np.stack([own[a[keep]], own[b[keep]]]))
    return tuple(np.unique(np.concatenate(links, axis=1), axis=1))


def _few(keys: DataFrame) -> tuple[DataFrame, bool]:
    """The stored keys, to be broadcast if they are few, and whether they are."""
    keys = base.store(keys, "keys")
    few = keys.count() <= BROADCAST_KEYS
    return F.broadcast(keys) if few else keys, few


def _verified(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``a, b`` whose shingles have a similarity of 4/5 or more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.slices(whole, limit=SET_BYTES):
                offsets, found = shingle_sets(batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(found.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column("key"), lists], names=["key", "shingles"])

    wanted = _few(pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct())[0]
    texts = rows.join(wanted, "key", "left_semi").select("key", "text").dropDuplicates(["key"])
    found = base.store(texts.mapInArrow(base.trimmed(sets), "key long, shingles array<long>"), "compared-sets")
    both = pairs.join(found.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(found.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    shared = F.size(F.array_intersect("x", "y"))
    return both.where(9 * shared >= 4 * (F.size("x") + F.size("y"))).select("a", "b")


def first_shingles(offsets: np.ndarray, found: np.ndarray, hot: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, place and shingle of the first shingles of each set: a fifth of them and one more.

    Sets of a similarity of 4/5 or more share one of these.  Shingles are in the order of their hashes, but for those in
    ``hot`` (sorted), which come last, by their rank.
    """
    size = np.diff(offsets)
    text = np.repeat(np.arange(len(size)), size)
    if len(hot):
        place = np.minimum(np.searchsorted(hot, found), len(hot) - 1)
        found = found[np.lexsort((found, np.where(hot[place] == found, rank[place] + 1, 0), text))]
    at = np.arange(len(found)) - offsets[text]
    first = 5 * at <= size[text]
    return text[first], at[first], found[first]


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where the runs of equal rows begin, and the end."""
    n = len(columns[0])
    new = np.ones(n, dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.flatnonzero(new), n)


def _cuts(count: np.ndarray, block: int) -> Iterator[slice]:
    """Slices whose counts sum up to ``block`` at most, or that hold one entry."""
    total, lo = np.cumsum(count), 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + block, "right")))
        yield slice(lo, hi)
        lo = hi


def meetings(token: np.ndarray, key: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, block: int = 1 << 20) -> Iterator[dict[str, np.ndarray]]:
    """``a, b, x, y, n, near``: keys and sizes of pairs of different roots that meet where both may still share 4/5 (``near``, of all that come), and how often, a block of meetings at a time.

    Sets of sizes x <= y have that similarity if they share 4/9 of x + y.  Where the first shingle that they share
    stands at i and j, they share no more than x - i and y - j; so they meet at i <= (5x - 4y) / 9 and j <= (5y - 4x) / 9, and pairs that meet at other places only are never made.
    Rows of a shingle, size and root are a class, which comes to nothing but classes whose first place fits.
    """
    if not len(token):
        return
    rows = np.lexsort((at, root, size, token))
    token, key, root, size, at = (x[rows] for x in (token, key, root, size, at))
    # Classes of a shingle and size are in the order of their first places.
    begin = _runs(token, size, root)
    begin, end = begin[:-1], begin[1:]
    order = np.lexsort((at[begin], size[begin], token[begin]))
    begin, end = begin[order], end[order]
    first, length = at[begin], size[begin]
    # Runs of classes of a shingle and size, the run of each class, and the last run of its shingle that it reaches.
    run = _runs(token[begin], length)
    of = np.repeat(np.arange(len(run) - 1), np.diff(run))
    shingle = np.cumsum(np.append(0, token[begin[run[1:-1]]] != token[begin[run[:-2]]]))
    wide = int(size.max()) * 2 + 2
    place = shingle * wide + length[run[:-1]]
    reach = np.searchsorted(place, shingle[of] * wide + (5 * length - 9 * first) // 4, "right")
    by_first, by_row = of * wide + first, np.repeat(np.arange(len(order)), (end - begin)[np.argsort(order)]) * wide + at

    def fitting(c: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many rows of each class stand no later than ``most``."""
        return np.searchsorted(by_row, order[c] * wide + most, "right") - begin[c]

    one = np.flatnonzero(reach > of)
    for cut in _cuts(reach[one] - of[one], block):
        # Each class comes to every run of sizes that it reaches; in its own to the classes before it.
        c = one[cut]
        n = reach[c] - of[c]
        c, to = np.repeat(c, n), base.spread(of[c], n)
        fits = np.searchsorted(by_first, to * wide + (5 * length[run[to]] - 4 * length[c]) // 9, "right")
        n = np.where(to == of[c], c, fits) - run[to]
        for cut in _cuts(n, block):
            a = np.repeat(c[cut], n[cut])
            b = base.spread(run[to[cut]], n[cut])
            other = root[begin[a]] != root[begin[b]]
            a, b = a[other], b[other]
            x, y = length[a], length[b]
            na, nb = fitting(a, (5 * x - 4 * y) // 9), fitting(b, (5 * y - 4 * x) // 9)
            for cut in _cuts(na, block):
                i, from_b, nb_each = base.spread(begin[a[cut]], na[cut]), np.repeat(begin[b[cut]], na[cut]), np.repeat(nb[cut], na[cut])
                for cut in _cuts(nb_each, block):
                    j, k = base.spread(from_b[cut], nb_each[cut]), np.repeat(i[cut], nb_each[cut])
                    j, k = np.where(key[k] < key[j], j, k), np.where(key[k] < key[j], k, j)
                    yield from _met(key, size, k, j)


def _met(key: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray) -> Iterator[dict[str, np.ndarray]]:
    """The pairs of rows i and j, each once."""
    if len(i):
        order = np.lexsort((key[j], key[i]))
        i, j = i[order], j[order]
        new = _runs(key[i], key[j])
        i, j = i[new[:-1]], j[new[:-1]]
        yield {"a": key[i], "b": key[j], "x": size[i], "y": size[j], "n": np.diff(new), "near": np.ones(len(i), dtype=bool)}


#: Pairs that are looked at; the number of meetings rules none of them out, as places that are near end where 4/9 of x + y are left.
REACHES = "near"


def _hot_shingles(rows: DataFrame, n: int, most: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that came twice or more in a sample of texts (one of 8, some 200,000 at most), and their ranks by count.

    They only shape the order of shingles, which changes how many texts meet, not which of them are found; where there are more than
    ``most``, the counts are taken from the highest down as long as all shingles of a count fit, so the driver gets no more than it keeps.
    """

    def every(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.slices(whole, limit=SET_BYTES):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_sets(batch.column("text"))[1].view(np.int64))], names=["token"])

    share = min(1 / 8, 200_000 / max(n, 1))
    few = rows.where(F.pmod(F.xxhash64("key"), F.lit(1 << 30)) < int((1 << 30) * share)).select("text")
    counts = base.store(few.mapInArrow(base.trimmed(every), "token long").groupBy("token").agg(F.count("*").alias("n")).where("n >= 2"), "shingle-counts")
    least, held = None, 0
    for times, shingles in sorted(counts.groupBy("n").count().collect(), reverse=True):
        if (held := held + shingles) > most:
            break
        least = times
    found = counts.where(F.col("n") >= least if least else F.lit(False)).toPandas()
    hot, count = found["token"].to_numpy(dtype=np.int64).view(np.uint64), found["n"].to_numpy(dtype=np.int64)
    order = np.argsort(hot)
    return hot[order], np.argsort(np.lexsort((hot, count)))[order]


def remaining_links(docs: DataFrame, links: DataFrame, n: int) -> DataFrame:
    """``a, b``: all pairs of 4/5 or more between texts (``n`` of them) that ``links`` leave in different groups."""
    rows = _keyed(docs)
    hot, rank = _hot_shingles(rows, n)
    parts = 1 + (rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0) // MEET_BYTES

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.slices(whole, limit=SET_BYTES):
                # Copies in a slice come once.
                once = np.sort(np.unique(np.asarray(batch.column("key"), dtype=np.int64), return_index=True)[1])
                batch = batch.take(pa.array(once))
                offsets, found = shingle_sets(batch.column("text"))
                text, at, token = first_shingles(offsets, found, hot, rank)
                key, root = (np.asarray(batch.column(c), dtype=np.int64)[text] for c in ("key", "root"))
                columns = [token.view(np.int64), key, root, np.diff(offsets)[text].astype(np.int32), at.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["token", "key", "root", "size", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, pa.schema([("token", pa.int64()), ("key", pa.int64()), ("root", pa.int64()), ("size", pa.int32()), ("at", pa.int32())]))
        if table.num_rows:
            for met in meetings(*[table.column(c).to_numpy().astype(np.int64) for c in ("token", "key", "root", "size", "at")]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in met.values()], names=list(met))

    roots, _ = _few(components(links).withColumnRenamed("node", "key"))
    named = rows.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "text")
    met = named.mapInArrow(base.trimmed(emit), "token long, key long, root long, size int, at int").repartition(parts, "token")
    found = met.mapInArrow(base.trimmed(meet), "a long, b long, x long, y long, n long, near boolean")
    pairs = base.store(found.where(REACHES).select("a", "b").distinct(), "met-pairs")
    return base.store(_verified(rows, pairs), "remaining-links")


def similar_links(docs: DataFrame, shard: int = WIDE_SHARD, sample: int = SAMPLE // 4) -> DataFrame:
    """``a, b``: links between the keys of near copies, all of them checked by their shingles, which join all that have 4/5.

    Links by fingerprints come first; ``remaining_links`` then finds every pair between groups that these leave apart.
    """
    links, n = print_links(docs, shard, sample)
    return base.store(links.unionByName(remaining_links(docs, links, n)), "similar-links")


def print_links(docs: DataFrame, shard: int = WIDE_SHARD, sample: int = SAMPLE // 4) -> tuple[DataFrame, int]:
    """``a, b``: links between the keys of near copies whose fingerprints meet in trees, checked by their shingles; and the number of keys.

    Trees are grown on a bounded sample.  A leaf that holds many times its share of the sample is a ball: the driver picks
    its leaders from the sample, and what is surely near one links to it where it is read, so that a group of copies of
    any size stays out of the shuffle.
    """
    rows = _keyed(docs)
    prints = base.store(wide_prints(rows).dropDuplicates(["key"]), "wide-fingerprints")
    n = prints.count()
    size = min(sample, 64 * n // shard) if n > shard else 0
    leaf = max(64, size * shard // max(n, 1))
    few = base.sample(prints, n, size, "key").toPandas()
    keys, points = few["key"].to_numpy(dtype=np.int64), few[WIDE].to_numpy(dtype=np.int64).view(np.uint64)
    trees = [grow(part_of(points, t), leaf) for t in range(TABLES)]
    heads: dict[tuple[int, int], list[int]] = {}
    for t in range(TABLES):
        which, at = deal(part_of(points, t), trees[t], 0)
        for ball in np.flatnonzero(np.bincount(at, minlength=1) > 4 * leaf).tolist():
            own = which[at == ball]
            leaders, of = gather(points[own], LEADERS)
            heads[t, ball] = [int(own[x]) for x in leaders if (of == x).sum() > leaf // 4]
    lead = np.unique([x for found in heads.values() for x in found]).astype(np.int64)
    lead_keys, lead_points = keys[lead], points[lead]

    def led(wide: np.ndarray, own: np.ndarray) -> np.ndarray:
        """The first leader that each point is surely near to, by place (-1: none); a leader has none."""
        out = np.full(len(wide), -1)
        for i in range(len(lead)):
            free = np.flatnonzero(out < 0)
            out[free[wide_distance(wide[free], lead_points[i]) <= SURE]] = i
        out[np.isin(own, lead_keys)] = -1
        return out

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("key"), dtype=np.int64)
            wide = np.stack([np.asarray(batch.column(w), dtype=np.int64) for w in WIDE], axis=1).view(np.uint64)
            free = np.flatnonzero(led(wide, own) < 0)
            for t in range(TABLES):
                which, at = deal(part_of(wide[free], t), trees[t], RADIUS // 2)
                rows = batch.take(pa.array(free[which]))
                yield pa.RecordBatch.from_arrays([pa.array((np.int64(t) << 32) + at), *rows.columns], names=["shard", "key", *WIDE])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column("key"), dtype=np.int64)
            wide = np.stack([np.asarray(batch.column(w), dtype=np.int64) for w in WIDE], axis=1).view(np.uint64)
            of = led(wide, own)
            yield pa.RecordBatch.from_arrays([pa.array(own[of >= 0]), pa.array(lead_keys[of[of >= 0]])], names=["a", "b"])

    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        wide = np.ascontiguousarray(rows[WIDE].to_numpy(dtype=np.int64)).view(np.uint64)
        a, b = shard_edges(part_of(wide, int(rows["shard"].iloc[0]) >> 32), wide)
        own = rows["key"].to_numpy()
        base.trim()
        return pd.DataFrame({"a": own[a], "b": own[b]})

    schema = "shard long, key long, " + ", ".join(f"{w} long" for w in WIDE)
    found = prints.mapInArrow(base.trimmed(route), schema).groupBy("shard").applyInPandas(join, "a long, b long")
    if len(lead):
        found = found.unionByName(prints.mapInArrow(base.trimmed(cover), "a long, b long"))
    pairs = base.store(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near-pairs")
    return base.store(_verified(rows, pairs), "print-links"), n


def keep_one(docs: DataFrame, shard: int = WIDE_SHARD, sample: int = SAMPLE // 4) -> DataFrame:
    """Of each group of linked near copies the row with the smallest doc_id (null last), with all its columns.

    Near copies share 4/5 or more of their five-word shingles (whole texts, ASCII lower case).  Every link that is
    taken has that similarity, and all pairs that have it end in one group.
    Null text counts as empty, and texts without words are equal.  Of rows that repeat
    the text and the doc_id of the row that stays one stays.  An empty table gives an empty result.
    """
    roots = base.store(components(similar_links(docs, shard, sample)).withColumnRenamed("node", "key"), "roots")
    ids = base.store(_keyed(docs).select("doc_id", "key"), "ids")
    order = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "key")
    first = base.store(ids.groupBy("key").agg(F.min(order).alias("first"), F.count("*").alias("n")), "first-rows")
    # Keys of a group, or with several rows; all other rows stay as they are.
    linked = roots.select("key").unionByName(roots.select(F.col("root").alias("key"))).distinct()
    touched = linked.unionByName(first.where("n > 1").select("key")).distinct()
    named = first.join(roots, "key", "left").groupBy(F.coalesce("root", "key").alias("root")).agg(F.min("first").alias("first"))
    stay = named.select(F.col("first.key").alias("key"), F.col("first.doc_id").alias("winner"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("key"))
    touched, few = _few(touched)
    some = whole.join(touched, "key", "left_semi") if few else whole
    rows = some.join(stay, "key").where(F.col("doc_id").eqNullSafe(F.col("winner")))
    kept = rows.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy("doc_id"))).where("place = 1").select("row.*")
    return whole.join(touched, "key", "left_anti").select("row.*").unionByName(kept) if few else kept
