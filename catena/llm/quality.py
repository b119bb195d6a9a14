"""Quality rules: a conditional random field labels each line as content or boilerplate.

A document's lines are a sequence.  A linear-chain conditional random field over
simple features of the lines is trained on labelled documents: lines of good
documents are content, lines of bad ones boilerplate, and besides whole documents it sees mixed ones, where lines of
one kind stand within a document of the other, so that it learns where labels change.  Viterbi decoding finds the best
labelling of all lines of a document, and the share of its words that stand in
content lines decides whether it stays.  Documents that fail a few plain counts go
before that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.llm import base

SYMBOLS = "[#*$%&|<>]"
#: Labelled documents that training reads at most, of each label.
TRAIN_DOCS = 1000
#: Longer documents are not taken for training (all are labelled later, whole).
TRAIN_CHARS = 50_000
#: A document stays if at least this share of its words stands in content lines.
MIN_SHARE = 0.5


class Lines:
    """Words, lines and features of some texts, as arrays."""

    def __init__(self, texts: pa.Array) -> None:
        parts = pc.split_pattern(texts, "\n")
        self.line_offsets = parts.offsets.to_numpy().astype(np.int64)
        self.line_offsets -= self.line_offsets[0]
        self.lines = parts.flatten()
        self.word_offsets, self.codes, self.distinct = base.coded_words(self.lines)
        self.docs = np.repeat(np.arange(len(texts)), np.diff(self.line_offsets))
        self.doc_words = self.word_offsets[self.line_offsets]
        self.line_size = np.diff(self.word_offsets)
        count = lambda x: np.asarray(x, dtype=np.int64)
        d = self.distinct
        self.chars = count(pc.utf8_length(d))
        self.symbols = count(pc.count_substring_regex(d, SYMBOLS))
        self.digits = count(pc.count_substring_regex(d, "[0-9]"))
        self.ends = np.asarray(pc.match_substring_regex(d, r"[.!?]$"))
        self.capital = np.asarray(pc.match_substring_regex(d, r"^\p{Lu}"))

    def duplicate_lines(self) -> np.ndarray:
        """For each line whether it has a word and equals an earlier line of its text."""
        code = np.asarray(self.lines.dictionary_encode().indices, dtype=np.int64)
        order = np.lexsort((code, self.docs))
        same = np.concatenate([[False], (np.diff(code[order]) == 0) & (np.diff(self.docs[order]) == 0)])
        out = np.zeros(len(code), dtype=bool)
        out[order] = same
        return out & (self.line_size > 0)

    def repeated_words(self) -> np.ndarray:
        """For each word whether a 3-word window around it comes twice or more in its text."""
        n = len(self.codes)
        out = np.zeros(n, dtype=bool)
        if n < 3:
            return out
        owner = np.repeat(np.arange(len(self.doc_words) - 1), np.diff(self.doc_words))
        start = np.flatnonzero(owner[2:] == owner[:-2])
        c = self.codes.astype(np.uint64)
        key = base.mix(base.mix(base.mix(c[start] + np.uint64(1)) ^ c[start + 1]) + np.uint64(0x632BE59BD9B4E019) * c[start + 2])
        key = base.mix(key ^ base.mix(owner[start].astype(np.uint64)))
        order = np.argsort(key)
        k = key[order]
        same = k[1:] == k[:-1]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        hit = start[order[twice]]
        for i in range(3):
            out[hit + i] = True
        return out

    def features(self, repeated: np.ndarray, duplicate: np.ndarray) -> np.ndarray:
        """One row a line; the last column is 1."""
        sums = lambda x: base.group_sums(x, self.word_offsets).astype(np.float64)
        n = self.line_size.astype(np.float64)
        some = np.maximum(n, 1)
        chars = np.maximum(sums(self.chars[self.codes]), 1)
        line = np.repeat(np.arange(len(n)), self.line_size)
        twin = np.zeros(len(self.codes))
        twin[1:] = (self.codes[1:] == self.codes[:-1]) & (line[1:] == line[:-1])
        full = self.line_size > 0
        last = np.zeros(len(n))
        last[full] = self.ends[self.codes[self.word_offsets[1:][full] - 1]]
        first = np.zeros(len(n))
        first[full] = self.capital[self.codes[self.word_offsets[:-1][full]]]
        short = sums(self.chars[self.codes] <= 1)
        return np.stack([
            np.log1p(n) / 4, n == 0, n < 4, np.minimum(chars / some / 10, 2), 5 * sums(self.symbols[self.codes]) / chars, 5 * sums(self.digits[self.codes]) / chars, last, first,
            sums(self.ends[self.codes]) / some * 3, sums(repeated) / some, sums(twin) / some * 2 + short / some, duplicate, np.ones(len(n)),
        ], axis=1)


def viterbi(scores: np.ndarray, offsets: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best label (0 or 1) of each line; ``scores`` has a row a line, ``moves`` the scores of label pairs.

    All sequences advance together; of equally good labellings content (1) is taken.
    """
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    from_zero = np.zeros((len(scores), 2), dtype=bool)
    best = np.zeros((len(size), 2))
    for t, m in enumerate(alive):
        own = order[:m]
        at = offsets[own] + t
        if t:
            come = best[own, :, None] + moves[None]
            from_zero[at] = come[:, 0, :] > come[:, 1, :]
            best[own] = come.max(axis=1) + scores[at]
        else:
            best[own] = scores[at]
    labels = np.zeros(len(scores), dtype=np.int64)
    now = (best[:, 1] >= best[:, 0]).astype(np.int64)
    for t in range(len(alive) - 1, -1, -1):
        own = order[: alive[t]]
        at = offsets[own] + t
        lab = now[own]
        labels[at] = lab
        now[own] = np.where(from_zero[at, lab], 0, 1) if t else lab
    return labels


def train(features: np.ndarray, offsets: np.ndarray, labels: np.ndarray, steps: int = 150, rate: float = 0.1, decay: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (feature x label) and moves (label x label) that maximise the penalised conditional likelihood.

    Full-batch Adam on the exact gradient by forward and backward sums over all sequences at once.
    """
    weights, moves = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    first, second = [np.zeros_like(weights), np.zeros_like(moves)], [np.zeros_like(weights), np.zeros_like(moves)]
    size = np.diff(offsets)
    order = np.argsort(-size, kind="stable")
    alive = np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), side="left")
    starts = offsets[:-1][order]
    onehot = np.eye(2)[labels]
    inner = np.ones(len(labels), dtype=bool)
    inner[offsets[:-1][size > 0]] = False
    pair = np.zeros((2, 2))
    np.add.at(pair, (labels[np.flatnonzero(inner) - 1], labels[inner]), 1)
    each = max(1, len(labels))
    for step in range(1, steps + 1):
        s = features @ weights
        alpha, beta = np.zeros_like(s), np.zeros_like(s)
        for t, m in enumerate(alive):
            at = starts[:m] + t
            alpha[at] = s[at] + (np.logaddexp(alpha[at - 1, 0, None] + moves[0], alpha[at - 1, 1, None] + moves[1]) if t else 0)
        for t in range(len(alive) - 2, -1, -1):
            at = starts[: alive[t + 1]] + t
            ahead = beta[at + 1] + s[at + 1]
            beta[at] = np.logaddexp(moves[:, 0] + ahead[:, 0, None], moves[:, 1] + ahead[:, 1, None])
        total = np.logaddexp(*(alpha + beta).T)
        chance = np.exp(alpha + beta - total[:, None])
        nxt = np.flatnonzero(inner)
        both = np.exp(alpha[nxt - 1][:, :, None] + moves[None] + (s[nxt] + beta[nxt])[:, None, :] - total[nxt][:, None, None])
        grads = [features.T @ (chance - onehot) / each + decay * weights, (both.sum(axis=0) - pair) / each + decay * moves]
        for i, (value, g) in enumerate(zip((weights, moves), grads, strict=True)):
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.999 * second[i] + 0.001 * g * g
            value -= rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-9)
    return weights, moves


def mixtures(good: list[str], bad: list[str], seed: int = 3) -> tuple[list[str], list[int]]:
    """Training texts and the labels of all their lines: every document as it is, and pairs with one document put between two lines of the other."""
    rng = np.random.default_rng(seed)
    texts, labels = [], []

    def add(*parts: tuple[list[str], int]) -> None:
        texts.append("\n".join(line for lines, _ in parts for line in lines))
        labels.extend(y for lines, y in parts for _ in lines)

    for t in good:
        add((t.split("\n"), 1))
    for t in bad:
        add((t.split("\n"), 0))
    for i in range(max(len(good), len(bad))):
        outer, inner = (good[i % len(good)].split("\n"), 1), (bad[i % len(bad)].split("\n"), 0)
        if rng.random() < 0.5:
            outer, inner = inner, outer
        cut = int(rng.integers(0, len(outer[0]) + 1))
        add(*(p for p in ((outer[0][:cut], outer[1]), inner, (outer[0][cut:], outer[1])) if p[0]))
    return texts, labels


def learn(good: list[str], bad: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Weights and moves from good and bad texts."""
    base.one_thread()
    texts, labels = mixtures(good, bad)
    lines = Lines(pa.array(texts, pa.string()))
    return train(lines.features(lines.repeated_words(), lines.duplicate_lines()), lines.line_offsets, np.array(labels))


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> tuple[np.ndarray, np.ndarray] | None:
    """Train on at most ``most`` documents of each label, the same ones each run; None if a label is missing.

    ``labels`` has doc_id and quality (0 or 1); null labels are ignored.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").select(F.col("doc_id").cast("long"), F.col("quality").cast("int")).distinct()
    counts = {r["quality"]: r["count"] for r in known.groupBy("quality").count().collect()}
    picked = []
    for value in (0, 1):
        picked += base.sample(known.where(F.col("quality") == value), counts.get(value, 0), most, "doc_id").collect()
    if len({r["quality"] for r in picked}) < 2:
        return None
    small = docs.sparkSession.createDataFrame(picked, "doc_id long, quality int")
    rows = base.whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(small), "doc_id")
    rows = rows.where(F.length("text") <= TRAIN_CHARS).select("doc_id", "quality", "text").collect()
    rows = sorted(rows, key=lambda r: (r["doc_id"], r["quality"], r["text"]))
    good, bad = ([r["text"] for r in rows if r["quality"] == y] for y in (1, 0))
    return learn(good, bad) if good and bad else None


def assess(docs: DataFrame, model: tuple[np.ndarray, np.ndarray] | None, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, content_share.

    All lines of whole texts are labelled, however many there are.  Null text has no words.  A document fails the base with under 50 words, or if
    over half its words stand in 3-word windows that come twice or more.  Without
    a model every line is content.  Rows without a doc_id and repeated rows are judged like any
    other.  Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in base.slices(whole):
                lines = Lines(batch.column("text"))
                repeated, duplicate = lines.repeated_words(), lines.duplicate_lines()
                by_doc = lambda x, lines=lines: base.group_sums(x, lines.doc_words)
                n, n_repeat = np.diff(lines.doc_words), by_doc(repeated)
                failed = (n < 50) | (100 * n_repeat > 50 * n)
                share = np.ones(len(n))
                if model is not None:
                    labels = viterbi(lines.features(repeated, duplicate) @ model[0], lines.line_offsets, model[1])
                    share = base.group_sums(labels * lines.line_size, lines.line_offsets) / np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.array(n), pa.array(by_doc(lines.chars[lines.codes])), pa.array(by_doc(lines.symbols[lines.codes])), pa.array(base.group_sums(duplicate, lines.line_offsets)),
                    pa.array(n_repeat), pa.array(failed), pa.array(~failed & (share >= min_share)), pa.array(share),
                ], names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share"])

    rows = base.whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    return rows.mapInArrow(base.trimmed(run), "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double")
