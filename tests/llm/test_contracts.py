"""The ten queries against plain versions written from their contracts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
import xxhash

from catena.llm import base, packing, quality, queries, records, secret_scan

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def words(text):
    return WORD.findall(text.encode())


def rows(spark, sf_dir, name):
    return [r.asDict() for r in queries.QUERIES[name](spark, sf_dir).collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql_forms(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got = queries.QUERIES[name](spark, sf_dir)
    want = con.sql(f"SELECT {', '.join(got.columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_exact_dedup(spark, sf_dir, docs):
    groups = defaultdict(list)
    for d, t in docs.items():
        groups[re.sub(r"[\x20\x09-\x0D]+", " ", t)].append(d)
    want = {d: (min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g}
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in rows(spark, sf_dir, "op2_exact_dedup")} == want


def base_counts(text):
    w = words(text)
    seen, twins = set(), 0
    for line in text.split("\n"):
        if words(line):
            twins += line in seen
            seen.add(line)
    grams = Counter(zip(w, w[1:], w[2:]))
    hit = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    n = len(w)
    return n, sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", text)), twins, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_base(spark, sf_dir, docs):
    got = rows(spark, sf_dir, "op3_quality_rules")
    assert len(got) == len(docs)
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == base_counts(docs[r["doc_id"]]), r
        assert not (r["base_failed"] and r["kept"])


def test_token_records(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(base.tokenizer_path("byte_bpe_50k.json"))
    start = 0
    got = {r["doc_id"]: r for r in rows(spark, sf_dir, "op4_token_records")}
    for d in sorted(docs):
        ids = np.array([*model.encode(docs[d], add_special_tokens=False).ids, 0], dtype="<u4")
        assert (got[d]["start"], got[d]["n_tokens"], got[d]["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def check_packing(got, wanted):
    """``wanted``: ids by document.  All ids lie in one piece each; returns padded over used length."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(wanted)
    for d, pieces in by_doc.items():
        at = 0
        for r in sorted(pieces, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(wanted[d])
            assert r["ids_crc32"] == zlib.crc32(np.array(wanted[d][at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(wanted[d])
    used = padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.CAPACITY
        used += at
        padded += at if at & (at - 1) == 0 else packing.CAPACITY
    return padded / used


def test_packing(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(base.tokenizer_path("word_bpe_49k.json"))
    wanted = {d: [*model.encode(t, add_special_tokens=False).ids, 2] for d, t in docs.items()}
    assert check_packing(rows(spark, sf_dir, "op5_packing"), wanted) < 1.05


def removed(texts, window=50):
    first = {}
    for d in sorted(texts):
        w = words(texts[d])
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = {}
    for d, t in texts.items():
        w = words(t)
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())
    return out


def test_substring_dedup(spark, sf_dir, docs):
    want = removed(docs)
    assert sum(x[1] for x in want.values()) > 0
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows(spark, sf_dir, "op6_substring_dedup")} == want


def fingerprint(text):
    w = [x.lower() for x in words(text)]
    s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(prints):
    """Smallest reachable id of each, by comparing all pairs."""
    ids = sorted(prints)
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_simhash(spark, sf_dir, docs):
    prints = {d: fingerprint(t) for d, t in docs.items()}
    want = {d: (f"{prints[d]:016x}", c) for d, c in linked(prints).items()}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, sf_dir, "op9_simhash")} == want


def test_toxicity_held_out(spark):
    """On held-out labels the network finds most toxic documents and leaves nearly all clean ones (labels without any cause are noise)."""
    sf_dir = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    got = rows(spark, sf_dir, "op8_toxicity")
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    mine = [(r["predicted"], labels[r["doc_id"]]) for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(p for p, y in mine if y) / sum(y for _, y in mine) > 0.85
    assert sum(p for p, y in mine if not y) / sum(not y for _, y in mine) < 0.05


def test_secret_scan(spark):
    """The tables hold assignments of 40 hexadecimal digits: all are found and marked, and nothing else is."""
    sf_dir = "/root/testdata/sf0.01"
    got = rows(spark, sf_dir, "op1_secret_scan")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    planted = {(d, len(words(t[: m.start(1)]))) + (hashlib.sha256(m[1].encode()).hexdigest(),) for d, t in texts.items() for m in re.finditer(r'token\s=\s"([0-9a-f]{40})"', t, re.I)}
    found = {(r["doc_id"], r["word_index"], r["value_sha256"]) for r in got if r["is_secret"]}
    assert len(planted) > 5 and {(d, h) for d, _, h in planted} == {(d, h) for d, _, h in found}
    assert len(got) > len(found)


def test_crc32c_known_values():
    data = np.frombuffer(b"123456789" + bytes(32) + b"\xff" * 32 + bytes(range(32)), dtype=np.uint8)
    got = records.crc32c(data, np.array([0, 9, 41, 73, 105, 105]))
    assert [hex(x) for x in got] == ["0xe3069283", "0x8a9136aa", "0x62a8ab43", "0x46dd794e", "0x0"]


def test_encoder_equals_library():
    from tokenizers import Tokenizer

    texts = ["", " ", "  a  b", "a\n\n b\t c   d", "x  \ny", "it's we'll <|endoftext|> ok", "Élan  vital  x   y", "a 1 22 333!!! --", "Σίσυφος ΣΑΣ  Σ", "tail  ", "\n lead", "ａ　ｂ", "<|endoftext|>", "a  <|endoftext|>  b<|startoftext|>c", "<|ENDOFTEXT|> x", "plain words"]
    for name, lead in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        for ordinary in (False, True):
            model = Tokenizer.from_file(base.tokenizer_path(name))
            if ordinary:
                model.encode_special_tokens = True
            at, ids = base.CachedEncoder(base.tokenizer_path(name), lead, ordinary).encode(pa.array(texts))
            for i, t in enumerate(texts):
                assert ids[at[i] : at[i + 1]].tolist() == model.encode(t, add_special_tokens=False).ids, (name, t)


def test_forest_on_held_out_findings():
    """Findings drawn with another seed than those it was trained on."""
    forest = secret_scan.fit(secret_scan.labelled_findings())
    fresh = secret_scan.labelled_findings(1000, seed=99)
    chance = forest.chance(np.array([secret_scan.describe(*f[:5]) for f in fresh]))
    assert np.mean((chance >= 0.5) == np.array([f[5] for f in fresh], dtype=bool)) > 0.95


def test_quality_keeps_good_documents(spark):
    """On held-out labels good documents that pass the base counts stay and bad ones go."""
    sf_dir = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, labels.where("doc_id % 2 = 0"))
    known = {r["doc_id"]: r["quality"] for r in labels.where("doc_id % 2 = 1").collect()}
    got = [(r["kept"], known[r["doc_id"]]) for r in quality.assess(docs, model).collect() if r["doc_id"] in known and not r["base_failed"]]
    assert np.mean([k == bool(q) for k, q in got]) > 0.95


def test_quality_labels_lines(spark):
    """Trained on half the labelled documents, the field labels the lines of mixed documents of the other half."""
    sf_dir = "/root/testdata/sf0.01"
    rows_ = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    texts = {(h, q): [r["text"] or "" for r in rows_ if r["doc_id"] % 2 == h and r["quality"] == q] for h in (0, 1) for q in (0, 1)}
    weights, moves = quality.learn(texts[0, 1], texts[0, 0])
    assert moves[0, 0] > moves[0, 1] and moves[1, 1] > moves[1, 0]
    mixed, labels = quality.mixtures(texts[1, 1], texts[1, 0], seed=8)
    skip = sum(t.count("\n") + 1 for t in texts[1, 1] + texts[1, 0])
    lines = quality.Lines(pa.array(mixed[len(texts[1, 1]) + len(texts[1, 0]) :]))
    got = quality.viterbi(lines.features(lines.repeated_words(), lines.duplicate_lines()) @ weights, lines.line_offsets, moves)
    full = lines.line_size > 0
    assert np.mean((got == np.array(labels[skip:]))[full]) > 0.92
    share = base.group_sums(got * lines.line_size, lines.line_offsets) / np.maximum(np.diff(lines.doc_words), 1)
    assert np.mean((share > 0) & (share < 1)) > 0.7
