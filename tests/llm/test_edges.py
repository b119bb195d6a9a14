"""Nulls, empty and long texts, ties, repeated rows, empty tables, extra columns; hot groups."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from catena.llm import base, exact_dedup, mixing, packing, quality, records, secret_scan, simhash, substring_dedup, toxicity, warc
from catena.operators import graph
from tests.llm.test_contracts import base_counts, check_packing, fingerprint, linked, removed, words
from tests.llm.test_near_copies import kept as kept_near

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ["row", "key", "digest", "size", "first", "hash", "label", "part", "copies", "text_sha256", "component_id", "fingerprint", "place", "slot", "path", "kept", "predicted", "score", "winner", "a b.c"]


def odd_docs():
    long = " ".join(f"w{i % 977} x{i}" for i in range(30000))
    return [
        (1, "a b  c\n\nd", "en", "s1", 1), (2, None, None, None, None), (3, "", "en", "", 0), (4, " \t\n ", "en", "s2", 0), (5, "a b c d", "en", "s1", 1), (5, "a b c d", "en", "s1", 1), (6, long, "en", "s1", 1),
        (7, long, "en", "s2", 1), (None, "a b c d", "en", "s3", 1), (None, None, None, None, None), (8, "Éa ß\x1c x y <|endoftext|> ~ ~~\n", "fr", "é", 1), (9, "x", None, "s9", 1), (2**40, "a  b c\td", "en", None, 1),
    ]


def with_extra(df):
    return df.withColumns({c: F.lit("extra") for c in EXTRA})


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_docs(), SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, n=40):
    return spark.createDataFrame([(i, i % 2, i % 2) for i in range(n)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")


def read_records(d):
    folder = base.shared_folder(d.sparkSession, "records")
    return records.digest(d.sparkSession, folder, records.write(d, folder))


def read_archive(d):
    folder = base.shared_folder(d.sparkSession, "archive")
    pages = d.withColumnRenamed("doc_id", "page_id").withColumnRenamed("text", "html").withColumnRenamed("source", "url")
    return warc.read(d.sparkSession, folder, warc.write(pages, folder))


OPERATORS = {
    "records": read_records,
    "warc": read_archive,
    "secret": lambda d: secret_scan.scan(d, secret_scan.fit(secret_scan.labelled_findings(300), trees=5), path="source"),
    "dedup": exact_dedup.annotate,
    "dedup_rows": exact_dedup.deduplicate,
    "quality": lambda d: quality.assess(d, quality.fit(d, labels(d.sparkSession))),
    "packing": packing.pack,
    "substring": substring_dedup.remove_repeats,
    "mixing": mixing.report,
    "mixing_rows": mixing.mix,
    "toxicity": lambda d: toxicity.score(d, toxicity.fit(d, labels(d.sparkSession))),
    "toxicity_rows": lambda d: toxicity.drop_toxic(d, toxicity.fit(d, labels(d.sparkSession))),
    "simhash": simhash.near_duplicates,
    "simhash_rows": simhash.keep_one,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(none, name):
    assert OPERATORS[name](none).collect() == []


@pytest.mark.parametrize("name", OPERATORS)
def test_extra_columns_change_nothing(odd, name):
    plain, extra = OPERATORS[name](odd), OPERATORS[name](with_extra(odd))
    columns = [c for c in plain.columns if name != "packing" or c not in ("sequence_id", "offset")]
    assert sorted(map(repr, plain.select(*columns).collect())) == sorted(map(repr, extra.select(*columns).collect()))
    assert plain.columns == [c for c in extra.columns if not name.endswith("_rows") or c in plain.columns]


def test_exact_dedup_edges(odd):
    rows = exact_dedup.annotate(odd, counters=2).collect()
    by = {}
    for r in rows:
        by.setdefault(r["text_sha256"], []).append(r)
    assert len(rows) == 13 and all(sum(r["kept"] for r in g) == 1 and {r["group_size"] for r in g} == {len(g)} for g in by.values())
    empty = by[hashlib.sha256(b"").hexdigest()]
    assert sorted((r["doc_id"] or -1, r["keep_id"]) for r in empty) == [(-1, 2), (2, 2), (3, 2)]
    spaced = by[hashlib.sha256(b"a b c d").hexdigest()]
    assert {r["keep_id"] for r in spaced} == {1} and len(spaced) == 5
    assert exact_dedup.deduplicate(odd, counters=2).count() == len(by)


def test_exact_dedup_ties(spark):
    """Of rows that repeat the winning doc_id one and the same stays, however they are dealt."""
    rows = [(3, "a  b", "en", f"s{i}", i) for i in range(6)] + [(3, "a b", "fr", "t", 1), (4, "a b", "en", "s", 1), (None, "n", "en", "s", 1), (None, "n", "en", "r", 1)]
    found = {tuple(sorted(map(repr, exact_dedup.deduplicate(spark.createDataFrame(random.Random(k).sample(rows, len(rows)), SCHEMA).repartition(k + 1)).collect()))) for k in range(4)}
    assert len(found) == 1 and len(found.pop()) == 2


def test_heavy_hitters_are_found(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.4 else f"t{rng.randrange(900)}", "en", "s", 1) for i in range(4000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    few = exact_dedup.winners(base.store(df.selectExpr("doc_id", "unhex(sha2(text, 256)) digest", "doc_id row"), "d"), counters=8).collect()
    assert [bytes(r["digest"]) for r in few] == [hashlib.sha256(b"hot").digest()] and few[0]["copies"] == sum(r[1] == "hot" for r in rows)
    first = {}
    for i, t, *_ in rows:
        first.setdefault(t, i)
    assert {r["doc_id"]: r["keep_id"] for r in exact_dedup.annotate(df, counters=8).collect()} == {i: first[t] for i, t, *_ in rows}
    assert {r["doc_id"] for r in exact_dedup.deduplicate(df, counters=8).collect()} == set(first.values())


def test_quality_edges(odd):
    for r in quality.assess(odd, None).collect():
        texts = {d[1] or "" for d in odd_docs() if d[0] == r["doc_id"]}
        assert any((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(t) for t in texts)


def test_viterbi_equals_all_labellings():
    from itertools import product

    rng = np.random.default_rng(2)
    sizes = [0, 1, 5, 3, 7]
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    s, m = rng.normal(size=(sum(sizes), 2)), rng.normal(size=(2, 2))
    got = quality.viterbi(s, offsets, m)
    for lo, hi in zip(offsets[:-1], offsets[1:]):
        score = lambda y: sum(s[lo + i, v] for i, v in enumerate(y)) + sum(m[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        if hi > lo:
            assert tuple(got[lo:hi]) == max(product((0, 1), repeat=hi - lo), key=score)


def test_crf_gradient_learns():
    rng = np.random.default_rng(1)
    y = np.repeat(rng.integers(0, 2, 60), 5)
    x = np.stack([y + rng.normal(size=300) * 0.8, np.ones(300)], axis=1)
    w, m = quality.train(x, np.arange(0, 301, 30), y)
    assert (quality.viterbi(x @ w, np.arange(0, 301, 30), m) == y).mean() > 0.82 and m[0, 0] > m[0, 1]


def test_substring_random(spark):
    rng = random.Random(5)
    passages = [[rng.choice("abcd") + str(rng.randrange(30)) for _ in range(rng.choice((8, 30, 60, 120, 230, 260)))] for _ in range(12)]
    texts = {}
    for i in range(150):
        w = []
        while len(w) < rng.randrange(1, 400):
            w += rng.choice(passages) if rng.random() < 0.5 else [str(rng.randrange(10**6)) for _ in range(rng.randrange(1, 15))]
        texts[i] = " ".join(w)
    texts[200], texts[201] = "z " * 80, "z " * 60
    df = spark.createDataFrame([(k, v, "en", "s", 1) for k, v in texts.items()], SCHEMA)
    texts[202], texts[203] = "x y " * 300, "q x y " + "x y " * 200
    df = spark.createDataFrame([(k, v, "en", "s", 1) for k, v in texts.items()], SCHEMA)
    for window in (2, 8, 50, 200):
        want = removed(texts, window)
        got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring_dedup.remove_repeats(df.repartition(5), window).collect()}
        assert got == want


def test_substring_levels():
    assert [substring_dedup.levels(w) for w in (2, 8, 50, 200)] == [[1, 2], [4, 8], [13, 25, 50], [13, 25, 50, 100, 200]]
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, 60).astype(np.uint64)
    for width in (1, 2, 3, 7, 38):
        assert substring_dedup.first_smallest(x, width).tolist() == [i + int(x[i : i + width].argmin()) for i in range(60 - width + 1)]


def test_equal_words_send_one_row(spark):
    docs = spark.createDataFrame([(1, "z " * 20000, 5), (2, "z " * 20000 + "y", 6)], "doc_id long, text string, row_key long").coalesce(1)
    assert docs.mapInArrow(lambda b: substring_dedup._anchor_rows(b, 50, 13, None), substring_dedup.ANCHORS).count() <= 3
    places = docs.withColumn("places", F.sequence(F.lit(0), F.lit(19987)).cast("array<int>"))
    found = places.mapInArrow(lambda b: substring_dedup._window_rows(b, 50, 13), substring_dedup.WINDOWS).collect()
    assert len(found) <= 3


def test_rows_that_share_an_id_keep_their_own_passages(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(1, passage), (2, passage), (2, "a b " + passage + " c"), (2, "short")]
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 60, 0), (2, 1, 0), (2, 60, 60), (2, 63, 60)]


def test_substring_edges(odd):
    got = [(r["doc_id"], r["n_words"], r["n_removed"]) for r in substring_dedup.remove_repeats(odd).collect()]
    assert len(got) == 13 and (7, 60000, 60000) in got and (6, 60000, 0) in got and got.count((5, 4, 0)) == 2 and got.count((None, 0, 0)) == 1


def test_targets_share_everything(spark):
    sizes = {"a": 10, "b": 1, "c": 1000, "d": 4, "e": 0, None: 300}
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(df).collect()}
    names = [*sorted(k for k in sizes if k), None]
    weight, cap = {k: i % 3 + 1 for i, k in enumerate(names)}, {k: 3 * v for k, v in sizes.items()}
    want, open_ = {k: 0.0 for k in sizes}, set(sizes)
    total, left = sum(sizes.values()), sum(sizes.values())
    while True:
        share = {k: left * weight[k] / sum(weight[x] for x in open_) for k in open_}
        over = {k for k in open_ if share[k] > cap[k]}
        if not over:
            want |= share
            break
        for k in over:
            want[k] = cap[k]
        open_ -= over
        left = total - sum(want[k] for k in sizes if k not in open_)
    assert got == pytest.approx(want) and sum(got.values()) == pytest.approx(total)


def mixed(rows, passes=3):
    """Words taken of each row (doc_id, source, size), by ranking all finish times in one list."""
    names = [*sorted({s for _, s, _ in rows if s is not None}), *([None] if any(s is None for _, s, _ in rows) else [])]
    size = {s: sum(n for _, x, n in rows if x == s) for s in names}
    weight, target, open_ = {s: i % 3 + 1 for i, s in enumerate(names)}, {}, set(names)
    while open_:
        left = sum(size.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] >= passes * size[s]}
        target |= {s: passes * size[s] for s in over} if over else share
        open_ -= over or open_
    line = []
    for s in names:
        own = sorted((hashlib.md5(f"42:{d}".encode()).hexdigest(), d, n) for d, x, n in rows if x == s)
        so_far = 0
        for turn in range(passes):
            for key, d, n in own:
                so_far += n
                if target[s] > 0:
                    line.append((so_far / target[s], s is None, s or "", turn, key, d, n))
    taken, used = {d: 0 for d, _, _ in rows}, 0
    for *_, d, n in sorted(line):
        used += n
        if used > sum(size.values()):
            break
        taken[d] += n
    return taken


@pytest.mark.parametrize("slots", [None, 1, 7, 5000])
def test_mixing_equals_one_ranking(spark, slots):
    """However many slots the shuffled order has."""
    r = random.Random(5)
    rows = [(i, r.choice(["a", "a", "a", "b", "c", "d", None]), r.choice([0, 1, 5, 30, 400])) for i in range(300)]
    docs = spark.createDataFrame([(d, "w " * n, s) for d, s, n in rows], "doc_id long, text string, source string")
    meta, cuts, few = mixing.plan(docs, slots=slots)
    got = {x["doc_id"]: x["copies"] * x["size"] for x in mixing.taken(meta, cuts, few).collect()}
    assert got == mixed(rows)


def test_mix_takes_what_the_report_says(odd):
    from collections import Counter

    taken = Counter(r["doc_id"] for r in mixing.mix(odd).collect())
    for r in mixing.report(odd).collect():
        assert r["taken"] <= 3 * r["size"]
        if r["doc_id"] not in (None, 5):
            assert r["taken"] == taken[r["doc_id"]] * r["size"]


def test_packing_edges(odd):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(base.tokenizer_path("word_bpe_49k.json"))
    ids = lambda t: [*model.encode(t or "", add_special_tokens=False).ids, 2]
    got = [r.asDict() for r in packing.pack(odd.where("doc_id <> 5")).collect()]
    check_packing(got, {d[0]: ids(d[1]) for d in odd_docs() if d[0] not in (None, 5)})
    assert sum(r["length"] for r in packing.pack(odd).collect()) == sum(len(ids(d[1])) for d in odd_docs())


@pytest.mark.parametrize("n", [0, 1, 255, 256, 2048, 3000, 4095, 4096, 9000])
def test_cut_covers(n):
    pieces = packing.cut(n)
    assert sum(x for _, x in pieces) == n and all(x == packing.CAPACITY // k for k, x in pieces if k <= packing.CLASSES)


def test_records_edges(spark, odd, tmp_path):
    folder = f"file://{tmp_path}/r"
    index = records.write(odd, folder)
    got = records.digest(spark, folder, index).orderBy("start").collect()
    assert len(got) == 13 and [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda d: (d is not None, d or 0))
    assert all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    assert records.read(spark, folder, index.where("doc_id = 8")).head()["ids"][-1] == 0
    some = records.read(spark, folder, index.where("doc_id IN (1, 5, 9)")).collect()
    assert sorted(r["doc_id"] for r in some) == [1, 5, 5, 9] and all(r["n_tokens"] == len(r["ids"]) for r in some)
    whole = {(r["doc_id"], r["start"]): r["ids_crc32"] for r in got}
    assert {r["ids_crc32"] for r in some} <= set(whole.values())
    name = next((tmp_path / "r").glob("*.records"))
    data = bytearray(name.read_bytes())
    data[20] ^= 1
    with pytest.raises(ValueError):
        records.unframe(bytes(data))


def test_records_order_and_width(spark, tmp_path):
    """Equal and missing ids are spread over files; ids beyond 16 bits take 4 bytes."""
    rows = [(None if i % 3 else 7, f"text {i}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = [records.digest(spark, f"file://{tmp_path}/{k}", records.write(docs.repartition(k), f"file://{tmp_path}/{k}")).orderBy("start").collect() for k in (3, 5)]
    assert found[0] == found[1] and [r["doc_id"] for r in found[0]] == [None] * 400 + [7] * 200
    folder = f"file://{tmp_path}/wide"
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    index = records.write(docs, folder, end_id=70_000)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r["ids"][-1] == 70_000 for r in records.read(spark, folder, index).collect())
    assert len(list((tmp_path / "wide").glob("*.records"))) > 4


def test_tree_join_equals_all_pairs():
    rng = np.random.default_rng(7)
    seeds = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = np.concatenate([seeds[rng.integers(0, 40, 1500)] ^ (np.uint64(1) << rng.integers(0, 64, 1500, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 12, 1500, dtype=np.uint64)) for _ in range(1)])
    points = np.unique(np.concatenate([seeds, near, rng.integers(0, 2**63, 2000, dtype=np.uint64)]))
    want = linked({i: int(p) for i, p in enumerate(points)})
    for leaf in (16, 300, 10**6):
        got = simhash.link_shard(points, 2, leaf)
        assert {i: int(g) for i, g in enumerate(got)} == want
    forest = simhash.Forest(len(points))
    simhash.link_ball(points, np.arange(len(points)), 2, forest)
    assert {i: int(g) for i, g in enumerate(forest.find(np.arange(len(points))))} == want


def test_shards_lose_no_pair(spark):
    rng = np.random.default_rng(9)
    points = np.unique(rng.integers(0, 2**63, 3000, dtype=np.uint64))
    points = np.unique(np.concatenate([points, points[:500] ^ np.uint64(5), points[:300] ^ np.uint64(1 << 40)]))
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fingerprint long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(df, shard=200, sample=5000)).collect()}
    want = linked({int(p): int(p) for p in points})
    assert all((roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b]) for a in list(want)[:400] for b in list(want)[:400])
    assert len(roots) >= 800


def test_balls_are_dealt_out(spark):
    """Fingerprints around one point, which no vantage point halves, beside others: all links are found."""
    rng = np.random.default_rng(11)
    centre = rng.integers(0, 2**63, dtype=np.uint64)
    near = [centre ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a, b in rng.integers(0, 64, (900, 2))]
    points = np.unique(np.array([centre, *near, *rng.integers(0, 2**63, 400, dtype=np.uint64)], dtype=np.uint64))
    tree = simhash.grow(points, 64)
    assert simhash._balls(points, tree, 64)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fingerprint long")
    roots = {r["node"]: r["root"] for r in graph.components(simhash.links(df, shard=60, sample=5000)).collect()}
    want = linked({int(p): int(p) for p in points.view(np.int64)})
    assert all((roots.get(a, a) == roots.get(b, b)) == (want[a] == want[b]) for a in list(want)[:300] for b in list(want)[:300])
    assert len(set(roots.values())) == len({v for k, v in want.items() if sum(x == v for x in want.values()) > 1})


def test_simhash_edges(odd):
    got = simhash.near_duplicates(odd).collect()
    docs = {d[0]: d[1] or "" for d in odd_docs() if d[0] is not None}
    want = linked({d: fingerprint(t) for d, t in docs.items()})
    assert len(got) == 13 and all(r["component_id"] == want[r["doc_id"]] for r in got if r["doc_id"] is not None)


def test_components_of_a_path(spark):
    n = 200
    df = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(df).collect()}
    assert got == {i: 0 for i in range(1, n + 1)} | {501: 500}


def test_warc_edges(spark, tmp_path):
    body = "x" * 1200
    pages = [(1, "http://a/ b\r\nX: y", body), (2, None, body), (3, "u", None), (4, "u", "é" * 400), (9, "v", body), (9, "v", body), (None, "w", body), (5, "s", "short"), (6, "s", "short")]
    df = with_extra(spark.createDataFrame(pages, "page_id long, url string, html string"))
    folder = f"file://{tmp_path}/w"
    index = warc.write(df, folder)
    got = warc.read(spark, folder, index).collect()
    kinds = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got), key=repr)
    responses = [(3, 0), (4, 800), (9, 1200), (9, 1200), (None, 1200), (5, 5), (6, 5)]
    assert kinds == sorted([(1, "revisit", 9, 1200), (2, "revisit", 9, 1200), *((p, "response", None, n) for p, n in responses)], key=repr)
    assert [r["url"] for r in got if r["page_id"] == 1] == ["http://a/%20b%0D%0AX:%20y"]
    assert warc.read(spark, folder, index.where("page_id = 4")).head()["payload"].decode() == "é" * 400
    none = warc.write(df.limit(0), f"{folder}0")
    assert warc.read(spark, f"{folder}0", none).collect() == []


def test_warc_very_long_html(spark, tmp_path):
    long = "<p>é" * 3_000_000
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", long + "x")], "page_id long, url string, html string")
    folder = f"file://{tmp_path}/long"
    got = {r["page_id"]: (r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read(spark, folder, warc.write(pages, folder), payloads=False).collect()}
    assert got == {1: ("revisit", 2, 15_000_000), 2: ("response", None, 15_000_000), 3: ("response", None, 15_000_001)}


def test_toxicity_reads_whole_words():
    stem = "a" * 24
    pairs, count = toxicity.pairs_of(pa.array([stem + "b", stem + "c", "", "ab"]))
    cut = np.split(pairs, np.cumsum(count)[:-1])
    assert count.tolist() == [26, 26, 1, 3] and cut[0].tolist() != cut[1].tolist()
    texts = pa.array(["x " + "y" * 100 + " z", "", "é" * 49])
    offsets, codes, distinct = toxicity.words_of(texts)
    back = [[distinct[int(c)].as_py() for c in codes[a:b]] for a, b in zip(offsets[:-1], offsets[1:])]
    assert back == [["x", "y" * 48, "y" * 48, "y" * 4, "z"], [], ["é" * 48, "é"]]


def test_toxicity_gradient():
    rng = np.random.default_rng(3)
    net = toxicity.Network(["aa", "bb", "cc"], np.array([0.3, -0.2, 0.1, 0], dtype=np.float32), ["zz"], np.array([0.7, 0], dtype=np.float32), {k: v.astype(np.float64) for k, v in toxicity.start_weights(rng, 3).items()}, 0.0)
    words_ = pa.array(["aa", "bb", "cc", "zzz"])
    codes, length = np.array([[0, 1, 2, 3], [3, 3, 1, 1]]), np.array([4, 3])
    y, weight = np.array([1, 0]), np.array([1.0, 2.0])
    g, _ = toxicity.gradients(net, codes, length, net.inputs(words_), y, weight)
    for name in ("word", "pair", "w0", "u0", "u1", "b1", "attend", "ask", "out", "bias"):
        v = net.weights[name]
        at = np.unravel_index(np.abs(g[name]).argmax(), v.shape)
        keep, found = v[at], []
        for step in (1e-3, -1e-3):
            v[at] = keep + step
            found.append(toxicity.gradients(net, codes, length, net.inputs(words_), y, weight)[1])
        v[at] = keep
        assert (found[0] - found[1]) / 2e-3 == pytest.approx(float(g[name][at]), rel=0.05, abs=1e-4), name


def test_windows_cover_every_word():
    offsets = np.array([0, 0, 3, 64, 65 + 64, 1000])
    start, length, text = toxicity.windows_of(offsets)
    seen = {int(i) for s, n in zip(start, length) for i in range(s, s + n)}
    assert seen == set(range(1000)) and all(offsets[t] <= s and s + n <= offsets[t + 1] for s, n, t in zip(start, length, text))


def test_pipeline_stages(spark, sf_dir):
    """Each stage against a plain version on its own input."""
    from collections import Counter

    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES:
        out = base.store(stage(spark, kept, sf_dir), f"test-{name}")
        rows = [(r["doc_id"], r["text"] or "", r["source"]) for r in kept.collect()]
        texts = {d: t for d, t, _ in rows}
        if name == "packing":
            model = Tokenizer.from_file(base.tokenizer_path("word_bpe_49k.json"))
            ids = {d: [*model.encode(t, add_special_tokens=False).ids, 2] for d, t in texts.items()}
            times = Counter(d for d, *_ in rows)
            got = out.collect()
            assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == Counter({(d, len(ids[d])): n for d, n in times.items()})
            assert all(zlib.crc32(np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes()) == r["ids_crc32"] for r in got)
            assert sum(r["length"] for r in got) == sum(len(ids[d]) * n for d, n in times.items())
            ends = {}
            for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
                assert r["offset"] == ends.get(r["sequence_id"], 0) and r["offset"] + r["length"] <= 4096
                ends[r["sequence_id"]] = r["offset"] + r["length"]
            break
        assert out.columns == docs.columns
        got = [r["doc_id"] for r in out.collect()]
        if name == "toxicity":
            net = toxicity.fit(kept, spark.read.parquet(f"{sf_dir}/labels.parquet"))
            assert sorted(got) == sorted(d for d, t, _ in rows if net.score(pa.array([t]))[0] < 0.3)
        elif name == "exact_dedup":
            first = {}
            for d in sorted(texts):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[d]), d)
            assert sorted(got) == sorted(first.values())
        elif name == "near_dedup":
            assert [(False, d) for d in sorted(got)] == kept_near([(d, t) for d, t, _ in rows])
        elif name == "mixing":
            size = {d: len(words(t)) for d, t, _ in rows}
            want = mixed([(d, s, size[d]) for d, _, s in rows])
            times = Counter(got)
            assert all(times[d] * size[d] == want[d] for d in texts)
        kept = out
