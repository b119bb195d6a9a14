"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is scored in overlapping windows of words; its score is that of its worst
window.  A word enters the network by what training learned about the word (an
embedding, and its smoothed log-odds among the training labels) and by its
characters (the log-odds of its telling prefixes, and the mean of embeddings of
its byte pairs), so words that training never saw have a say too.  Two recurrent passes, one in each direction, give a
state for every word; attention weighs the states into one vector and a
logistic unit scores it.

Training and scoring are plain numpy.  Training sees a bounded sample of labelled
documents: for each of them the window that the network finds worst.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catena.llm import base

#: Words of a window, and words from one window's start to the next one's.
WINDOW, STRIDE = 64, 48
#: Labelled documents of each label that training reads at most, and the longest of them in characters.
TRAIN_DOCS, TRAIN_CHARS = 1500, 50_000
THRESHOLD = 0.3
#: Sizes: words with their own embedding, embedding of a word, of its characters, state of one direction, attention.
VOCABULARY, WORD_DIM, CHAR_DIM, STATE, ATTEND = 20_000, 6, 6, 8, 8
#: Byte pairs are hashed to this many embeddings; a word's pairs are summed this many at a time.
PAIRS, BLOCK = 2048, 1 << 20
#: Words with more characters are cut to pieces of so many (texts without spaces, joined strings), so that windows cover all of them.
PIECE = 48
#: Text that is scored at once.
SCORE_BYTES = 2 << 20
#: Lengths of prefixes, in characters, and the number of rows (words or prefixes need as many documents) before one counts.
PREFIXES, SUPPORT = (2, 3, 4, 5, 6), 5
EDGE = " \t\r\n.,;:!?\"'()[]{}<>|*#&%$-_/\\"


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is kept from training (null ids: no)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def plain(words: pa.Array) -> pa.Array:
    """Lower case, without punctuation at the ends."""
    return pc.utf8_trim(pc.utf8_lower(words), characters=EDGE)


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets of each text's words, a code for each word, and the distinct words; long words come in pieces."""
    offsets, codes, distinct = base.coded_words(texts)
    long = np.flatnonzero(np.asarray(pc.greater(pc.utf8_length(distinct), PIECE)))
    if not len(long):
        return offsets, codes, distinct
    parts = [w for w in distinct.to_pylist()]
    count, pieces = np.ones(len(parts), dtype=np.int64), {}
    for i in long.tolist():
        pieces[i] = [parts[i][k : k + PIECE] for k in range(0, len(parts[i]), PIECE)]
        count[i] = len(pieces[i])
    flat = pa.array([p for i, w in enumerate(parts) for p in pieces.get(i, (w,))], pa.string()).dictionary_encode()
    own, start = np.asarray(flat.indices, dtype=np.int64), np.cumsum(count) - count
    at = np.concatenate([[0], np.cumsum(count[codes])])
    return at[offsets], own[base.spread(start[codes], count[codes])], flat.dictionary


def pairs_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashed byte pairs of all words, one after another (an edge counts as a byte), and how many each word has."""
    flat = words.cast(pa.binary())
    raw, at = np.frombuffer(flat.buffers()[2] or b"", dtype=np.uint8), np.frombuffer(flat.buffers()[1], dtype=np.int32)[flat.offset : flat.offset + len(flat) + 1].astype(np.int64)
    size = np.diff(at)
    # Each word's bytes between two zeros.
    padded = np.zeros(int((size + 2).sum()), dtype=np.int64)
    begin = np.cumsum(size + 2) - (size + 2)
    padded[base.spread(begin + 1, size)] = raw[base.spread(at[:-1], size)]
    left = base.spread(begin, size + 1)
    return (padded[left] * 257 + padded[left + 1] * 31 + 7) % PAIRS, size + 1


def windows_of(offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and length of every window, and its text; the last window of a text ends with it."""
    n = np.diff(offsets)
    more = np.maximum(0, -(-(n - WINDOW) // STRIDE))
    count = np.where(n > 0, more + 1, 0)
    text = np.repeat(np.arange(len(n)), count)
    k = base.spread(np.zeros(len(n), dtype=np.int64), count)
    start = np.minimum(k * STRIDE, np.maximum(0, n[text] - WINDOW))
    return offsets[:-1][text] + start, np.minimum(n[text], WINDOW), text


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Network:
    """Weights by name, and what was learned about words."""

    words: list[str]
    odds: np.ndarray
    prefixes: list[str]
    prefix_odds: np.ndarray
    weights: dict[str, np.ndarray]
    floor: float

    @cached_property
    def known(self) -> tuple[pa.Array, pa.Array]:
        """Words and prefixes to look up."""
        return pa.array(self.words, pa.string()), pa.array(self.prefixes, pa.string())

    def telling(self, distinct: pa.Array) -> np.ndarray:
        """The largest log-odds of each word's prefixes."""
        best, known = np.zeros(len(distinct), dtype=np.float32), self.known[1]
        for k in PREFIXES:
            at = pc.index_in(pc.utf8_slice_codeunits(distinct, 0, k), value_set=known).fill_null(len(self.prefixes))
            best = np.maximum(best, self.prefix_odds[np.asarray(at, dtype=np.int64)])
        return best

    def inputs(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct word its input vector; its place in the vocabulary, byte pairs and their number."""
        known = pc.index_in(distinct, value_set=self.known[0]).fill_null(len(self.words))
        known = np.asarray(known, dtype=np.int64)
        pair, count = pairs_of(distinct)
        w = self.weights
        chars = np.zeros((len(known), CHAR_DIM), dtype=w["pair"].dtype)
        word = np.repeat(np.arange(len(known)), count)
        for lo in range(0, len(pair), BLOCK):
            own = word[lo : lo + BLOCK]
            heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            chars[own[heads]] += np.add.reduceat(w["pair"][pair[lo : lo + BLOCK]], heads, axis=0)
        chars /= count[:, None]
        return np.concatenate([w["word"][known], self.odds[known][:, None], self.telling(distinct)[:, None], chars], axis=1), known, pair, count

    def states(self, feeds: list[np.ndarray], codes: np.ndarray, length: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """States of both directions for windows (rows of ``codes``); what the gradient needs if ``keep``."""
        b, steps = codes.shape
        h_all = np.zeros((steps, b, 2 * STATE), dtype=np.float32)
        whole = bool((length == steps).all())
        trace: list = [[], []]
        for side in (0, 1):
            u = self.weights[f"u{side}"]
            feed = feeds[side]
            h = np.zeros((b, STATE), dtype=np.float32)
            for t in range(steps) if side == 0 else range(steps - 1, -1, -1):
                x = feed[codes[:, t]]
                uh = h @ u
                gates = sigmoid(x[:, : 2 * STATE] + uh[:, : 2 * STATE])
                z, r = gates[:, :STATE], gates[:, STATE:]
                new = np.tanh(x[:, 2 * STATE :] + r * uh[:, 2 * STATE :])
                after = new + z * (h - new)
                if not whole:
                    after = np.where((t < length)[:, None], after, h)
                if keep:
                    trace[side].append((t, h, z, r, new, uh[:, 2 * STATE :]))
                h = after
                h_all[t, :, side * STATE : (side + 1) * STATE] = h
        return h_all, trace

    def pool(self, h: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Logits of windows from their states, with attention's parts."""
        w = self.weights
        seen = np.tanh(h @ w["attend"])
        score = seen @ w["ask"]
        score = np.where(np.arange(len(h))[:, None] < length[None, :], score, np.float32(-1e9))
        score = np.exp(score - score.max(axis=0))
        alpha = score / score.sum(axis=0)
        context = np.einsum("tb,tbh->bh", alpha, h)
        return context @ w["out"] + w["bias"][0], context, alpha, seen

    def feeds(self, inputs: np.ndarray) -> list[np.ndarray]:
        w = self.weights
        return [(inputs @ w[f"w{s}"] + w[f"b{s}"]).astype(np.float32) for s in (0, 1)]

    def logits(self, codes: np.ndarray, inputs: np.ndarray, start: np.ndarray, length: np.ndarray, block: int = 2048) -> np.ndarray:
        """Logits of windows over an array of word codes."""
        out = np.zeros(len(start), dtype=np.float32)
        feeds = self.feeds(inputs)
        steps = np.arange(WINDOW)
        for rows in (np.flatnonzero(length == WINDOW), np.flatnonzero(length < WINDOW)):
            for lo in range(0, len(rows), block):
                own = rows[lo : lo + block]
                width = int(length[own].max())
                at = np.minimum(start[own, None] + steps[None, :width], (start + length - 1)[own, None])
                h, _ = self.states(feeds, codes[at], length[own])
                out[own] = self.pool(h, length[own])[0]
        return out

    def score(self, texts: pa.Array) -> np.ndarray:
        """The worst window's probability of each text; texts without words have the training share of such or of all."""
        offsets, codes, distinct = words_of(texts)
        out = np.full(len(texts), self.floor)
        if len(codes):
            start, length, text = windows_of(offsets)
            found = self.logits(codes, self.inputs(plain(distinct))[0], start, length)
            some = np.diff(offsets) > 0
            heads = np.flatnonzero(np.concatenate([[True], np.diff(text) > 0]))
            out[some] = sigmoid(np.maximum.reduceat(found, heads).astype(np.float64))
        return out


def start_weights(rng: np.random.Generator, words: int) -> dict[str, np.ndarray]:
    depth = WORD_DIM + 2 + CHAR_DIM
    draw = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
    w = {"word": draw(words + 1, WORD_DIM, scale=0.05), "pair": draw(PAIRS, CHAR_DIM, scale=0.1)}
    for s in (0, 1):
        w |= {f"w{s}": draw(depth, 3 * STATE, scale=0.3), f"u{s}": draw(STATE, 3 * STATE, scale=0.3), f"b{s}": np.zeros(3 * STATE, dtype=np.float32)}
    return w | {"attend": draw(2 * STATE, ATTEND, scale=0.3), "ask": draw(ATTEND, scale=0.3), "out": draw(2 * STATE, scale=0.3), "bias": np.zeros(1, dtype=np.float32)}


def gradients(net: Network, codes: np.ndarray, length: np.ndarray, inputs: tuple, labels: np.ndarray, weight: np.ndarray) -> tuple[dict, float]:
    """Gradient of the weighted cross-entropy over windows, and its value."""
    w, (x, known, pair, count) = net.weights, inputs
    feeds = net.feeds(x)
    h, trace = net.states(feeds, codes, length, keep=True)
    logit, context, alpha, seen = net.pool(h, length)
    p = sigmoid(logit)
    total = float(weight.sum())
    loss = float((weight * (np.logaddexp(0, logit) - labels * logit)).sum() / total)
    d = ((p - labels) * weight / total).astype(np.float32)
    g = {"out": context.T @ d, "bias": np.array([d.sum()], dtype=np.float32)}
    dcontext = d[:, None] * w["out"]
    dh = alpha[:, :, None] * dcontext[None]
    dalpha = np.einsum("tbh,bh->tb", h, dcontext)
    dscore = alpha * (dalpha - (alpha * dalpha).sum(axis=0))
    g["ask"] = np.einsum("tb,tba->a", dscore, seen)
    dseen = dscore[:, :, None] * w["ask"] * (1 - seen * seen)
    g["attend"] = np.einsum("tbh,tba->ha", h, dseen)
    dh += dseen @ w["attend"].T
    dx = np.zeros_like(x)
    for side in (0, 1):
        u, carry = w[f"u{side}"], np.zeros((len(codes), STATE), dtype=np.float32)
        du, dfeed = np.zeros_like(u), np.zeros_like(feeds[side])
        for t, before, z, r, new, un in reversed(trace[side]):
            on = (t < length)[:, None]
            grad = dh[t, :, side * STATE : (side + 1) * STATE] + carry
            grad, rest = np.where(on, grad, 0), np.where(on, 0, grad)
            dnew = grad * (1 - z) * (1 - new * new)
            dz = grad * (before - new) * z * (1 - z)
            dr = dnew * un * r * (1 - r)
            dgate = np.concatenate([dz, dr, dnew], axis=1)
            duh = np.concatenate([dz, dr, dnew * r], axis=1)
            du += before.T @ duh
            carry = grad * z + duh @ u.T + rest
            np.add.at(dfeed, codes[:, t], dgate)
        g[f"u{side}"], g[f"w{side}"], g[f"b{side}"] = du, x.T @ dfeed, dfeed.sum(axis=0)
        dx += dfeed @ w[f"w{side}"].T
    g["word"], g["pair"] = np.zeros_like(w["word"]), np.zeros_like(w["pair"])
    np.add.at(g["word"], known, dx[:, :WORD_DIM])
    np.add.at(g["pair"], pair, np.repeat(dx[:, WORD_DIM + 2 :] / count[:, None], count, axis=0))
    return g, loss


def log_odds(doc: np.ndarray, item: np.ndarray, n_items: int, labels: np.ndarray) -> np.ndarray:
    """Log-odds of label 1 in documents with an item against label 0, moved toward 0 by one and a half standard errors."""
    once = np.unique(np.stack([doc, item]), axis=1) if len(doc) else np.zeros((2, 0), dtype=np.int64)
    good, bad = (np.bincount(once[1][labels[once[0]] == y], minlength=n_items) for y in (0, 1))
    wide = [int((labels == y).sum()) for y in (0, 1)]
    gap = np.log((bad + 0.5) / (wide[1] - bad + 0.5)) - np.log((good + 0.5) / (wide[0] - good + 0.5))
    sure = np.sign(gap) * np.maximum(0, np.abs(gap) - 1.5 * np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)))
    return np.where(good + bad >= SUPPORT, sure, 0.0)


def learn(texts: list[str], labels: np.ndarray, weight: np.ndarray, seed: int = 7, rounds: int = 3, steps: int = 25, batch: int = 128, rate: float = 0.01) -> Network:
    """Train on whole texts; in each round every text is shown by its worst window so far and clean ones by another, too.

    A round has about ``steps`` batches: a small sample is gone through more often.
    """
    base.one_thread()
    rng = np.random.default_rng(seed)
    offsets, codes, distinct = words_of(pa.array(texts, pa.string()))
    names_coded = plain(distinct).dictionary_encode()
    vocabulary = names_coded.dictionary
    codes = np.asarray(names_coded.indices, dtype=np.int64)[codes] if len(codes) else codes
    names = vocabulary.to_pylist()
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    sure = log_odds(doc, codes, len(names), labels)
    often = np.bincount(codes, minlength=len(names))
    kept = [i for i in np.argsort(-often, kind="stable")[:VOCABULARY].tolist() if names[i] and (sure[i] != 0 or often[i] >= 2 * SUPPORT)]
    prefixes, odds = [], [np.zeros(0)]
    for k in PREFIXES:
        cut = pc.utf8_slice_codeunits(vocabulary, 0, k).dictionary_encode()
        found = log_odds(doc, np.asarray(cut.indices, dtype=np.int64)[codes], len(cut.dictionary), labels)
        # A prefix counts where it is as long as its length says: shorter ones are whole words.
        found[np.asarray(pc.utf8_length(cut.dictionary)) < k] = 0
        good = np.flatnonzero(found > 0)
        prefixes += cut.dictionary.take(pa.array(good)).to_pylist()
        odds.append(found[good])
    half = lambda x: np.concatenate([*x, [0.0]]).astype(np.float32) / 2
    net = Network([names[i] for i in kept], half([sure[kept]]), prefixes, half(odds), start_weights(rng, len(kept)), 0.0)
    mean = float((weight * labels).sum() / weight.sum())
    net.weights["bias"][0] = math.log(max(mean, 1e-3) / max(1 - mean, 1e-3))
    empty = np.diff(offsets) == 0
    net.floor = float((weight * labels)[empty].sum() / weight[empty].sum()) if empty.sum() >= 20 else mean
    if not len(codes):
        return net
    start, length, text = windows_of(offsets)
    heads = np.flatnonzero(np.concatenate([[True], np.diff(text) > 0]))
    first, second, step = {k: np.zeros_like(v) for k, v in net.weights.items()}, {k: np.zeros_like(v) for k, v in net.weights.items()}, 0
    hint = np.maximum(np.maximum(sure, 0), 2 * net.telling(vocabulary))
    run = np.concatenate([[0.0], np.cumsum(hint[codes])])
    value = run[start + length] - run[start]
    for _ in range(rounds):
        worst = np.lexsort((-value, text))[heads]
        other = heads + (rng.random(len(heads)) * np.diff(np.concatenate([heads, [len(text)]]))).astype(np.int64)
        clean = other[labels[text[other]] == 0]
        shown = np.concatenate([worst, clean])
        for _ in range(max(1, round(steps * batch / len(shown)))):
            order = rng.permutation(len(shown))
            for lo in range(0, len(order), batch):
                own = shown[order[lo : lo + batch]]
                at = np.minimum(start[own, None] + np.arange(int(length[own].max())), (start + length - 1)[own, None])
                used, local = np.unique(codes[at], return_inverse=True)
                g, _ = gradients(net, local.reshape(at.shape), length[own], net.inputs(vocabulary.take(pa.array(used))), labels[text[own]], weight[text[own]])
                step += 1
                for k, v in net.weights.items():
                    d = g[k].astype(np.float32) + np.float32(1e-4) * v
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.01 * (d * d - second[k])
                    v -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
        value = net.logits(codes, net.inputs(vocabulary)[0], start, length)
    return net


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> Network | None:
    """Train on at most ``most`` documents of each label, the same ones each run; None if a label is missing.

    ``labels`` has doc_id and toxic (0 or 1).  Held-out rows and null labels are not read; a
    sample is weighed back to the share of each label among all the rows it is drawn from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).distinct()
    counts = Counter({r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()})
    picked = []
    for value in (0, 1):
        picked += base.sample(known.where(F.col("toxic") == value), counts[value], most, "doc_id").collect()
    small = docs.sparkSession.createDataFrame(picked, "doc_id long, toxic int")
    rows = base.whole_text(docs, F.col("doc_id").cast("long").alias("doc_id")).join(F.broadcast(small), "doc_id").where(F.length("text") <= TRAIN_CHARS)
    rows = sorted(rows.select("doc_id", "toxic", "text").collect(), key=lambda r: (r["doc_id"], r["toxic"], r["text"]))
    # Copies of one text would make its words look telling.
    rows = list({r["text"]: r for r in reversed(rows)}.values())[::-1]
    y = np.array([r["toxic"] for r in rows], dtype=np.int64)
    if len(set(y.tolist())) < 2:
        return None
    weight = np.where(y == 1, counts[1] / max(1, int((y == 1).sum())), counts[0] / max(1, int((y == 0).sum())))
    return learn([r["text"] for r in rows], y, (weight / weight.mean()).astype(np.float32))


def score(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    All windows of the whole text are scored, however long it is; words of over 48 characters count as several.  Null and empty texts have the share of toxic ones in training;
    without a network (no labels to learn from) every score is 0.  Rows without a doc_id are
    not held out; repeated rows are scored alike.  Other columns are ignored; an empty table gives
    an empty result.
    """
    sent = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            for batch in base.slices(whole, limit=SCORE_BYTES):
                found = np.zeros(batch.num_rows) if model is None else model.score(batch.column("text"))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found)], names=["doc_id", "score"])

    rows = base.whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").mapInArrow(base.trimmed(run), "doc_id long, score double")
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, net: Network | None, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose text scores under ``threshold``, with all their columns (rules as for ``score``)."""
    sent = docs.sparkSession.sparkContext.broadcast(net)
    # Other columns may have any name, so all go by number through Arrow.
    names, place = docs.columns, docs.columns.index("text")
    numbered = docs.toDF(*[f"c{i}" for i in range(len(names))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for whole in batches:
            if model is None:
                yield whole
                continue
            texts = whole.column(place).cast(pa.string()).fill_null("")
            kept = np.concatenate([model.score(b.column("text")) for b in base.slices(pa.RecordBatch.from_arrays([texts], names=["text"]), limit=SCORE_BYTES)] or [np.zeros(0)])
            yield whole.filter(pa.array(kept < threshold))

    return numbered.mapInArrow(base.trimmed(run), numbered.schema).toDF(*names)
