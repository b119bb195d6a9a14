"""The near-duplicate stage against all pairs of 5-word shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from catena.llm import simhash
from tests.llm.test_contracts import words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingle_set(text):
    w = [x.lower() for x in words(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def kept(rows, least=0.8):
    """The row that stays of each component, by comparing all pairs."""
    sets, group = [shingle_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]) - 1e-9 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return sorted((min((d is None, d or 0) for (d, _), h in zip(rows, group, strict=True) if h == g) for g in set(group)))


def near_rows(r):
    """Copies of texts with some words changed, a large group of copies of one text, and odd rows."""
    line = "this very common line comes in many of the documents here"
    rows = []
    for k in range(40):
        text = [f"w{r.randint(0, 400)}" for _ in range(r.randint(60, 150))]
        for _ in range(r.randint(1, 4)):
            copy = list(text)
            for _ in range(r.randint(0, 2)):
                copy[r.randrange(len(copy))] = f"v{r.randint(0, 999)}"
            rows.append((len(rows) if k % 5 else None, " ".join(copy) + (" " + line if k % 3 else "")))
    base_text = [f"g{i}" for i in range(120)]
    for i in range(60):
        copy = list(base_text)
        for _ in range(i % 3):
            copy[r.randrange(120)] = f"u{r.randint(0, 999)}"
        rows.append((1000 + i, " ".join(copy)))
    rows += [(2000, None), (2001, ""), (2002, " \t"), (2003, "a b"), (2004, "A  b"), (2005, "a b c"), (None, "A B"), (2006, line), (2007, line.upper())]
    r.shuffle(rows)
    return rows


def test_near_copies_by_similarity(spark, sf_dir):
    """Nothing goes that has no link of 0.8; what has one of 0.88 goes, and nearly all between."""
    rows = near_rows(random.Random(3))
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], SCHEMA)
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns
    got = sorted((x["doc_id"] is None, x["doc_id"] or 0) for x in out.collect())
    fewest, most = kept(rows), kept(rows, 0.88)
    assert len(fewest) <= len(got) <= len(fewest) + 0.1 * (len(most) - len(fewest)) + 1
    assert not set(fewest) - set(got) and not set(got) - set(most)
    assert stage(spark, docs.limit(0), sf_dir).collect() == []


@pytest.mark.parametrize("broadcast", [500_000, 10])
def test_many_shards_and_leaders(spark, monkeypatch, broadcast):
    """A group of near copies that fills a ball: leaders take it in before the shuffle, and nothing else changes, whether keys are broadcast or not."""
    monkeypatch.setattr(simhash, "BROADCAST_KEYS", broadcast)
    r = random.Random(8)
    rows = []
    for i in range(900):
        copy = [f"g{k}" for k in range(300)]
        for _ in range(i % 3):
            copy[r.randrange(300)] = f"u{r.randint(0, 999)}"
        rows.append((i, " ".join(copy)))
    for i in range(1500):
        rows.append((1000 + i, " ".join(f"w{r.randint(0, 10**6)}" for _ in range(40))))
        if i % 5 == 0:
            rows.append((5000 + i, rows[-1][1] + " end"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(x["doc_id"] for x in simhash.keep_one(docs, shard=100, sample=2000).collect())
    assert got == [0, *range(1000, 2500)]


def test_shortest_forest():
    rng = np.random.default_rng(6)
    n = 40
    a, b = np.triu_indices(n, 1)
    d = rng.integers(0, 50, len(a))
    use = rng.random(len(a)) < 0.2
    a, b, d = a[use], b[use], d[use]
    got = simhash.tree_edges(n, a, b, d)
    root, total, count = list(range(n)), 0, 0
    find = lambda x: x if root[x] == x else find(root[x])
    for k in np.argsort(d, kind="stable"):
        x, y = find(a[k]), find(b[k])
        if x != y:
            root[x], total, count = y, total + d[k], count + 1
    assert len(got) == count and d[got].sum() == total


def test_ball_beyond_all_pairs(monkeypatch):
    """Leaders link what is surely near them; the rest is compared as ever."""
    monkeypatch.setattr(simhash, "BALL", 50)
    rng = np.random.default_rng(2)
    seed = rng.integers(0, 2**63, (1, 4), dtype=np.uint64)
    wide = np.repeat(seed, 300, axis=0)
    for i in range(300):
        wide[i, 1 + i % 3] ^= np.uint64(1) << np.uint64(int(rng.integers(0, 63)))
    a, b = simhash.shard_edges(simhash.part_of(wide, 0), wide)
    forest = simhash.Forest(300)
    forest.link(a, b)
    assert (forest.find(np.arange(300)) == 0).all() and len(a) <= 400


def test_every_pair_of_four_fifths_is_joined(spark):
    """Pairs at 0.8 exactly and little above: fingerprints alone leave some apart."""
    r = random.Random(12)
    line = "this very common line comes in many of the documents here"
    rows = []
    for k in range(150):
        text = [f"w{r.randint(0, 10**6)}" for _ in range(r.randint(50, 90))]
        # Words cut from the end take a shingle each.
        cut = text[: 4 + -(-4 * (len(text) - 4) // 5)] if k % 2 else [*text[:-1], *text[: (len(text) - 4) // 5 - 4]]
        for words_of in (text, cut):
            rows.append((len(rows), " ".join(words_of) + (" " + line if k % 3 == 0 else "")))
    got = sorted((x["doc_id"] is None, x["doc_id"]) for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == kept(rows) and len(got) < 220


@pytest.mark.parametrize("n_hot", [0, 7])
def test_pairs_meet_at_their_first_shingles(n_hot):
    """Every pair of different roots that shares 4/5 meets, whatever shingles come last, also where pairs come in many blocks."""
    r = random.Random(n_hot)
    sets = []
    for _ in range(60):
        own = {r.randrange(10**6) for _ in range(r.randint(1, 40))} | {r.randrange(10) for _ in range(r.randint(0, 4))}
        sets += [own, {x for x in own if r.random() > 0.08} or own, {x for x in own if r.random() > 0.15} | {r.randrange(10)}]
    offsets = np.cumsum([0, *map(len, sets)])
    found = np.concatenate([np.array(sorted(s), dtype=np.uint64) for s in sets])
    text, at, token = simhash.first_shingles(offsets, found, np.arange(n_hot, dtype=np.uint64), np.arange(n_hot)[::-1].copy())
    root = text % 50
    met = {}
    for block in simhash.meetings(token.view(np.int64), text, root, np.diff(offsets)[text], at, block=9):
        for a, b, x, y, n, fits in zip(*(v.tolist() for v in block.values()), strict=True):
            assert (x, y) == (len(sets[a]), len(sets[b]))
            old = met.get((a, b), (0, False))
            met[a, b] = old[0] + n, old[1] or fits
    rule = simhash.REACHES.replace("AND", "and").replace("div", "//").replace("greatest", "max")
    met = {(a, b) for (a, b), (n, fits) in met.items() if eval(rule, {"near": fits, "n": n, "x": len(sets[a]), "y": len(sets[b])})}
    near = {(i, j) for j in range(len(sets)) for i in range(j) if i % 50 != j % 50 and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])}
    assert near and near <= met and all(a % 50 != b % 50 for a, b in met)


@pytest.mark.parametrize("block", [1, 9, 1 << 20])
def test_only_near_meetings_are_made(block):
    """Against all pairs of rows: those of one shingle and two roots whose places both leave 4/5 within reach, and no other."""
    for seed in range(20):
        g = np.random.default_rng(seed)
        n = int(g.integers(1, 30))
        keys, sizes, roots = g.integers(-(2**62), 2**62, n), g.integers(1, int(g.integers(2, 60)), n), g.integers(0, 8, n)
        token, who = np.unique(np.stack([g.integers(-3, 3, 60), g.integers(0, n, 60)]), axis=1)
        at = g.integers(0, sizes[who] // 5 + 1)
        want, got = {}, {}
        for p, a in enumerate(who):
            for q, b in enumerate(who):
                reach = min(9 * (sizes[a] - at[p]), 9 * (sizes[b] - at[q])) >= 4 * (sizes[a] + sizes[b])
                if token[p] == token[q] and keys[a] < keys[b] and roots[a] != roots[b] and reach:
                    want[keys[a], keys[b]] = want.get((keys[a], keys[b]), 0) + 1
        for met in simhash.meetings(token, keys[who], roots[who], sizes[who], at, block=block):
            assert met["near"].all()
            for a, b, times in zip(met["a"], met["b"], met["n"], strict=True):
                got[a, b] = got.get((a, b), 0) + times
        assert got == want


def test_family_below_the_limit_makes_few_meetings():
    """Of 400 texts that share a base but differ from each other by more than a fifth, those that are near meet, not all 80,000 pairs."""
    r = random.Random(5)
    sets = []
    for k in range(400):
        own = {*r.sample(range(150), 120), *range(10**6 + 100 * k, 10**6 + 100 * k + 30)}
        sets.append(own)
        if k % 20 == 0:
            sets.append({*own, 5 * 10**6 + k})
    offsets = np.cumsum([0, *map(len, sets)])
    found = np.concatenate([np.array(sorted(s), dtype=np.uint64) for s in sets])
    text, at, token = simhash.first_shingles(offsets, found, np.arange(150, dtype=np.uint64), np.arange(150))
    met = [(a, b) for m in simhash.meetings(token.view(np.int64), text, text, np.diff(offsets)[text], at) for a, b in zip(m["a"].tolist(), m["b"].tolist(), strict=True)]
    near = {(i, j) for j in range(len(sets)) for i in range(j) if 9 * len(sets[i] & sets[j]) >= 4 * (len(sets[i]) + len(sets[j]))}
    assert len(near) == 20 and near <= set(met) and len(met) < 100


def test_frequent_shingles_are_bounded(spark):
    """The highest counts are taken as long as all shingles of a count fit."""
    lines = [" ".join(f"{x}{i}" for i in range(8)) for x in "abc"]
    rows = spark.createDataFrame([(k, lines[0] if k % 2 else lines[1] if k % 3 else lines[2]) for k in range(3000)], "key long, text string")
    hot, rank = simhash._hot_shingles(rows, 3000)
    assert len(hot) == 12 and sorted(rank) == list(range(12)) and (np.diff(hot) > 0).all()
    few, _ = simhash._hot_shingles(rows, 3000, most=9)
    top = simhash.shingle_sets(pa.array(lines[:2]))[1]
    assert sorted(few) == sorted(top)
    assert len(simhash._hot_shingles(rows, 3000, most=3)[0]) == 0
