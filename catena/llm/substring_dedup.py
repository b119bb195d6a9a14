"""Repeated passages by level-wise doubling of window lengths.

The windows looked for have ``window`` words.  Their length is halved down to a short one (50, 25, 13 words), and
the levels are gone through from the shortest: only windows that repeat at one length are extended to twice
that length, and a level without survivors ends the work (the levels above it join an empty table, which
adaptive execution drops).

Below the whole length not every window needs a look: of each whole window that is still alive, only the
shorter window with the smallest hash inside it stands for it (its anchor).  Equal windows have equal anchors at
the same place, so a window whose anchor is in one document only can't repeat, and no repeated window is
missed.  At the whole length every window that is still alive is compared, by 128-bit hashes of all its words.

A document sends one row for each hash, with all its places, and of the documents of a slice (4 MB of text) only the
first one with a hash sends it; the others are known to repeat.  So a passage in any number of documents sends a row
a slice at most, and a text of equal words sends one row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from catena.llm import base

WINDOW = 50
#: Lengths are halved until they are at most this.
SHORTEST = 13
_STEP = np.uint64(0x9E3779B97F4A7C15)
ANCHORS = "hash long, doc_id long, row_key long, place int, more array<int>, repeats boolean"
RUN = "struct<place:int,run:int>"
WINDOWS = f"hash long, hash2 long, doc_id long, row_key long, place int, more array<{RUN}>, settled boolean"
_RUNS = pa.list_(pa.struct([("place", pa.int32()), ("run", pa.int32())]))


def levels(window: int, shortest: int = SHORTEST) -> list[int]:
    """Window lengths from the shortest to the whole; each is at most twice the one before it, and there are two at least."""
    found = [window]
    while found[0] > shortest or len(found) == 1:
        found.insert(0, -(-found[0] // 2))
    return found


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring windows, in order."""
    return base.mix(left * _STEP + base.mix(right + _STEP))


def window_hashes(words: np.ndarray, length: int) -> np.ndarray:
    """Hash of the ``length`` words from each position on; fewer positions than words.

    Windows double: two of length L make one of 2 L; the bits of ``length`` say which are joined.
    """
    out, have, power, size, left = None, 0, words, 1, length
    while left:
        if left & 1:
            out = power if out is None else _join(out[: max(0, len(out) - size)], power[have:])
            have += size
        left >>= 1
        if left:
            power = _join(power[: max(0, len(power) - size)], power[size:])
            size *= 2
    return out


def first_smallest(x: np.ndarray, width: int) -> np.ndarray:
    """The place of the minimum of ``width`` values from each position on, the first of equal ones, by doubling."""
    place, size = np.arange(len(x)), 1
    while size < width:
        step = min(size, width - size)
        n = max(0, len(x) - step)
        later = x[step:] < x[:n]
        x, place = np.where(later, x[step:], x[:n]), np.where(later, place[step:], place[:n])
        size += step
    return place


def _scattered(ids: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Keys for rows that meet no others: any task will do."""
    return base.mix(base.mix(ids.astype(np.uint64)) ^ keys.astype(np.uint64))


class Texts:
    """The words of some documents as two lanes of hashes, one document after another."""

    def __init__(self, batch: pa.RecordBatch) -> None:
        self.offsets, codes, distinct = base.coded_words(batch.column("text"))
        digests = b"".join(map(xxhash.xxh3_128_digest, distinct.cast(pa.binary()).to_pylist()))
        lanes = np.frombuffer(digests, dtype="<u8").reshape(-1, 2)
        self.words, self.second = lanes[codes, 0], lanes[codes, 1]
        self.ids, self.keys = np.asarray(batch.column("doc_id"), dtype=np.int64), np.asarray(batch.column("row_key"), dtype=np.int64)

    def starts(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Where whole windows begin, and the document of each."""
        count = np.maximum(0, np.diff(self.offsets) - window + 1)
        return base.spread(self.offsets[:-1], count), np.repeat(np.arange(len(count)), count)

    def anchors(self, starts: np.ndarray, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the windows of ``length`` words, and the place of the anchor of each whole window."""
        hashes = window_hashes(self.words, length)
        return hashes, first_smallest(base.mix(hashes), window - length + 1)[starts]

    def alive(self, batch: pa.RecordBatch, window: int, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Whole windows whose anchor of ``length`` words is among the documents' ``places``, and the document of each."""
        starts, owner = self.starts(window)
        found = batch.column("places")
        parent, place = np.asarray(pc.list_parent_indices(found), dtype=np.int64), np.asarray(pc.list_flatten(found), dtype=np.int64)
        good = np.zeros(len(self.words) + 1, dtype=bool)
        good[self.offsets[parent] + place] = True
        if not len(starts) or not good.any():
            return starts[:0], owner[:0]
        use = good[self.anchors(starts, window, length)[1]]
        return starts[use], owner[use]


def _grouped(keys: list[np.ndarray], ids: np.ndarray, owner: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of key, id, document and place; which begin a document's rows of a key; which have a smaller id before them in their key; which keys have two ids.

    The last three are given for each row in that order.
    """
    order = np.lexsort((places, owner, ids, *keys))
    i, o = ids[order], owner[order]
    new = np.zeros(len(i), dtype=bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(i)))
    first = new.copy()
    first[1:] |= o[1:] != o[:-1]
    return order, first, i > np.repeat(i[heads], size), np.repeat(i[heads] < i[heads + size - 1], size)


def _lists(group: np.ndarray, n: int, values: pa.Array) -> pa.Array:
    """Lists of the values by ascending group from 0 to n - 1; a group without values is null."""
    count = np.bincount(group, minlength=n)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), values, mask=pa.array(count == 0))


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int, length: int, before: int | None) -> Iterator[pa.RecordBatch]:
    """Anchors of ``length`` words: of all whole windows, or of those alive after the level of ``before`` words."""
    for whole in batches:
        for batch in base.slices(whole):
            if before is not None:
                batch = batch.filter(pc.is_valid(batch.column("places")))
            texts = Texts(batch)
            starts, owner = texts.starts(window) if before is None else texts.alive(batch, window, before)
            if not len(starts):
                continue
            hashes, at = texts.anchors(starts, window, length)
            # Anchors never go back, so equal ones stand together.
            new = np.append(True, at[1:] != at[:-1])
            at, owner = at[new], owner[new]
            place = at - texts.offsets[owner]
            order, first, later, shared = _grouped([hashes[at]], texts.ids[owner], owner, place)
            at, owner, place = at[order], owner[order], place[order]
            # One row for each hash and document that goes to be compared, with its other places; one for all that is settled of a document.
            send = np.flatnonzero(first & ~later)
            extra = np.flatnonzero(~first & ~later)
            group = np.cumsum(first & ~later)[extra] - 1
            done = np.flatnonzero(later)
            done = done[np.argsort(owner[done], kind="stable")]
            docs, which = np.unique(owner[done], return_inverse=True)
            rows = np.concatenate([owner[send], docs])
            places = pa.array(np.concatenate([place[send], np.zeros(len(docs), dtype=np.int64)]), pa.int32(), mask=np.arange(len(rows)) >= len(send))
            more = _lists(np.concatenate([group, which + len(send)]), len(rows), pa.array(np.concatenate([place[extra], place[done]]), pa.int32()))
            keys = np.concatenate([hashes[at[send]], _scattered(texts.ids[docs], texts.keys[docs])]).view(np.int64)
            repeats = np.concatenate([shared[send], np.ones(len(docs), dtype=bool)])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(texts.ids[rows]), pa.array(texts.keys[rows]), places, more, pa.array(repeats)], names=["hash", "doc_id", "row_key", "place", "more", "repeats"])


def _runs(group: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Consecutive places of a group as runs: the group of each run, and (place, run)."""
    new = np.ones(len(place), dtype=bool)
    new[1:] = (place[1:] != place[:-1] + 1) | (group[1:] != group[:-1])
    heads = np.flatnonzero(new)
    size = np.diff(np.append(heads, len(place)))
    return group[heads], pa.StructArray.from_arrays([pa.array(place[heads], pa.int32()), pa.array(size, pa.int32())], names=["place", "run"])


def _window_rows(batches: Iterator[pa.RecordBatch], window: int, before: int) -> Iterator[pa.RecordBatch]:
    """Windows of the whole length that are still alive, and as one row a document (``settled``) the runs that this slice settles."""
    for whole in batches:
        for batch in base.slices(whole):
            batch = batch.filter(pc.is_valid(batch.column("places")))
            texts = Texts(batch)
            starts, owner = texts.alive(batch, window, before)
            if not len(starts):
                continue
            hashes, second = (window_hashes(lane, window)[starts] for lane in (texts.words, texts.second))
            place = starts - texts.offsets[owner]
            order, first, later, _ = _grouped([hashes, second], texts.ids[owner], owner, place)
            hashes, second, owner, place = hashes[order], second[order], owner[order], place[order]
            send = np.flatnonzero(first & ~later)
            extra = np.flatnonzero(~first & ~later)
            some, some_runs = _runs(np.cumsum(first & ~later)[extra] - 1, place[extra])
            done = np.flatnonzero(later)
            done = done[np.lexsort((place[done], owner[done]))]
            docs, which = np.unique(owner[done], return_inverse=True)
            settled, settled_runs = _runs(which, place[done])
            rows = np.concatenate([owner[send], docs])
            alone = np.arange(len(rows)) < len(send)
            places = pa.array(np.concatenate([place[send], np.zeros(len(docs), dtype=np.int64)]), pa.int32(), mask=~alone)
            more = _lists(np.concatenate([some, settled + len(send)]), len(rows), pa.concat_arrays([some_runs, settled_runs])).cast(_RUNS)
            keys = [np.concatenate([x[send], _scattered(texts.ids[docs], texts.keys[docs])]).view(np.int64) for x in (hashes, second)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), pa.array(texts.ids[rows]), pa.array(texts.keys[rows]), places, more, pa.array(~alone)], names=["hash", "hash2", "doc_id", "row_key", "place", "more", "settled"])


def repeated_places(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, row_key, runs``: where windows begin that also begin in a document with a smaller id.

    ``docs`` has ``doc_id, row_key, text``; a run is (place, count) in words from 0.
    """
    alive, before = docs, None
    *short, _ = levels(window)
    for length in short:
        anchors = alive.mapInArrow(base.trimmed(lambda b, n=length, p=before: _anchor_rows(b, window, n, p)), ANCHORS)
        same = Window.partitionBy("hash")
        found = anchors.withColumns({"low": F.min("doc_id").over(same), "high": F.max("doc_id").over(same), "any": F.max("repeats").over(same)}).where("any OR low < high")
        places = found.groupBy("doc_id", "row_key").agg(F.concat(F.collect_list("place"), F.flatten(F.collect_list("more"))).alias("places"))
        # A left join without a filter, as in the caller: all of them then read one and the same shuffle of the texts.
        alive, before = docs.join(places, ["doc_id", "row_key"], "left"), length
    windows = alive.mapInArrow(base.trimmed(lambda b: _window_rows(b, window, before)), WINDOWS)
    smallest = F.min("doc_id").over(Window.partitionBy("hash", "hash2", "settled"))
    flagged = windows.withColumn("low", smallest).where("settled OR doc_id > low")
    own = F.collect_list(F.when(F.col("place").isNotNull(), F.struct("place", F.lit(1).alias("run"))))
    return flagged.groupBy("doc_id", "row_key").agg(F.concat(own, F.flatten(F.collect_list("more"))).cast(f"array<{RUN}>").alias("runs"))


def _removed(batches: Iterator[pa.RecordBatch], window: int, texts: bool) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in base.slices(whole):
            offsets, words = base.split_words(batch.column("text"))
            words = words.cast(pa.binary())
            runs = batch.column("runs")
            n = np.diff(offsets)
            parent = np.asarray(pc.list_parent_indices(runs), dtype=np.int64)
            flat = pc.list_flatten(runs)
            place, run = np.asarray(flat.field("place"), dtype=np.int64), np.asarray(flat.field("run"), dtype=np.int64)
            change = np.zeros(int(offsets[-1]) + 1, dtype=np.int64)
            np.add.at(change, offsets[parent] + place, 1)
            np.add.at(change, offsets[parent] + place + run + window - 1, -1)
            keep = np.cumsum(change)[:-1] == 0
            kept = base.group_sums(keep, offsets)
            left = words.filter(pa.array(keep)) if not keep.all() else words
            texts_left = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(kept)]), pa.int32()), left), b" ")
            sha = [hashlib.sha256(t).hexdigest() for t in texts_left.to_pylist()]
            columns = [batch.column("doc_id"), pa.array(n), pa.array(n - kept), pa.array(sha)]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if texts:
                columns.append(texts_left.cast(pa.string()))
                names.append("kept_text")
            yield pa.RecordBatch.from_arrays(columns, names=names)


def remove_repeats(docs: DataFrame, window: int = WINDOW, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 (and kept_text).

    Each word goes that is covered by ``window`` words in sequence that also
    begin in a document with a smaller doc_id; all windows are judged on the input.
    Whole texts of any length are read; memory holds a slice of 4 MB, or one longer text.
    Null text has no words.  Documents shorter than a window, and rows without a
    doc_id, stay whole and count as no one's earlier copy.  Rows equal in doc_id
    and text are one document that comes twice: both stay.  Other columns
    are ignored; an empty table gives an empty result.
    """
    if window < 2:
        raise ValueError("a window has at least two words")
    rows = base.whole_text(base.with_long(docs, "doc_id"), "doc_id")
    # Rows that share a doc_id are told apart by a hash of their text.
    rows = rows.withColumn("row_key", F.xxhash64("text"))
    named = rows.where("doc_id IS NOT NULL")
    runs = repeated_places(named, window)
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if texts else "")
    none = F.array().cast(f"array<{RUN}>")
    both = named.join(runs, ["doc_id", "row_key"], "left").select("doc_id", "text", F.coalesce("runs", none).alias("runs"))
    both = both.unionByName(rows.where("doc_id IS NULL").select("doc_id", "text", none.alias("runs")))
    return both.mapInArrow(base.trimmed(lambda b: _removed(b, window, texts)), schema)


#: DuckDB's form of ``remove_repeats`` (without the texts) for windows of 50 words, over documents with distinct ids.
SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
k AS (SELECT doc_id, i, ws[i] AS word, CASE WHEN i + 49 <= len(ws) THEN md5(array_to_string(ws[i:i + 49], ' ')) END AS key FROM p),
f AS (SELECT doc_id, i, word, key IS NOT NULL AND min(doc_id) OVER (PARTITION BY key) < doc_id AS again FROM k),
c AS (SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM f),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id
"""
