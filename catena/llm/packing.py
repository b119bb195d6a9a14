"""Harmonic packing of token documents into sequences of a fixed length.

Class ``i`` holds pieces of exactly ``capacity // i`` ids, and each of its bins
takes ``i`` of them, so bins close full, but for the rounding of the
division, and by counting alone.  Documents are cut to such pieces, the largest
first; what is left below the smallest class goes to the stream class, whose
bins are filled to the last id by cutting at their ends.

Every worker fills the bins of its own partition.  Pieces of bins that stay
open (fewer than ``i`` for each class and partition) are packed again in groups of
64 partitions, level by level, with the last level in one group.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catena.llm import base

CAPACITY = 4096
#: Classes with exact sizes; shorter ends go to the stream class, which is numbered one higher.
CLASSES = 16
FAN_IN = 64
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, kind int, sequence_id long, offset long, part long"
COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "kind", "sequence_id", "offset", "part"]


def cut(n: int, capacity: int = CAPACITY, classes: int = CLASSES) -> list[tuple[int, int]]:
    """The (class, length) of each piece of a document of ``n`` ids; the last may be of the stream class."""
    pieces = [(1, capacity)] * (n // capacity)
    rest = n % capacity
    while rest >= capacity // classes:
        i = -(-capacity // rest)
        while capacity // i > rest:
            i += 1
        if i > classes:
            break
        pieces.append((i, capacity // i))
        rest -= capacity // i
    return [*pieces, (classes + 1, rest)] if rest else pieces


class Bins:
    """The open bin of each class of one worker; sequences are numbered from ``base``."""

    def __init__(self, first: int, capacity: int, classes: int) -> None:
        self.next, self.capacity, self.classes = first, capacity, classes
        self.open: dict[int, list[list]] = defaultdict(list)
        self.fill = 0
        self.done: list[list] = []

    def close(self, kind: int) -> None:
        offset = 0
        for piece in self.open[kind]:
            piece[6:8] = self.next, offset
            offset += piece[2]
        self.done += self.open[kind]
        self.open[kind] = []
        self.next += 1

    def add(self, kind: int, doc_id: int | None, start: int, raw: bytes, total: int) -> None:
        """Add a piece given by its ids as little-endian bytes."""
        if kind <= self.classes:
            self.open[kind].append([doc_id, start, len(raw) // 4, zlib.crc32(raw), total, kind, None, None])
            if len(self.open[kind]) == kind:
                self.close(kind)
            return
        while raw:
            room = 4 * (self.capacity - self.fill)
            head, raw = raw[:room], raw[room:]
            self.open[kind].append([doc_id, start, len(head) // 4, zlib.crc32(head), total, kind, None, None])
            start += len(head) // 4
            self.fill += len(head) // 4
            if self.fill == self.capacity:
                self.close(kind)
                self.fill = 0


def repack(rows: pd.DataFrame, first: int, capacity: int = CAPACITY, classes: int = CLASSES, last: bool = False) -> pd.DataFrame:
    """Fill bins from pieces that were left over; those of bins that stay open keep no sequence.

    In the last group every piece gets a sequence: what the classes leave is
    packed together, longest first, each into the first bin with room.
    """
    rows = rows.sort_values(["kind", "doc_id", "start"], kind="stable").reset_index(drop=True)
    sequence, offset = np.full(len(rows), -1, dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    kinds, lengths = rows["kind"].to_numpy(), rows["length"].to_numpy()
    rest = []
    for kind in range(1, classes + 1):
        own = np.flatnonzero(kinds == kind)
        full = len(own) // kind * kind
        sequence[own[:full]] = first + np.arange(full) // kind
        offset[own[:full]] = np.arange(full) % kind * (capacity // kind)
        first += full // kind
        rest += own[full:].tolist()
    stream = np.flatnonzero(kinds > classes).tolist()
    bins: list[list] = []
    loose = sorted([*stream, *rest] if last else stream, key=lambda i: -lengths[i])
    open_from = 0
    for i in loose:
        n = int(lengths[i])
        for b in bins[open_from:]:
            if b[0] + n <= capacity:
                b[1].append(i)
                b[0] += n
                break
        else:
            bins.append([n, [i]])
        while open_from < len(bins) and bins[open_from][0] >= capacity - 1:
            open_from += 1
    for used, members in bins:
        if last or used >= capacity - capacity // 128:
            at = 0
            for i in members:
                sequence[i], offset[i] = first, at
                at += int(lengths[i])
            first += 1
    rows["sequence_id"], rows["offset"] = sequence, offset
    return rows


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", lead_space: bool = False, end_id: int = 2, capacity: int = CAPACITY, classes: int = CLASSES, ordinary: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Texts are encoded by the library's plain call, which makes special ids of the strings of special tokens; if
    ``ordinary`` these are text like any other.  Whole texts of any length are encoded, each in one piece.
    Null text counts as empty, so its document is the end id alone.  Rows that
    repeat a doc_id, or have none, are documents of their own.  A sequence's pieces
    lie without gaps from 0; it is padded from its last piece on.  Other columns
    are ignored; an empty table gives an empty result.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = base.encoder(base.tokenizer_path(tokenizer), lead_space, ordinary)
        part = TaskContext.get().partitionId()
        bins = Bins(part << 32, capacity, classes)
        for whole in batches:
            for batch in base.slices(whole, limit=base.TOKEN_SLICE_BYTES):
                at, ids = model.encode(batch.column("text"))
                raw = ids.astype("<u4").tobytes()
                end = int(end_id).to_bytes(4, "little")
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    mine, start, total = raw[4 * a : 4 * b] + end, 0, b - a + 1
                    for kind, n in cut(total, capacity, classes):
                        bins.add(kind, doc_id, start, mine[4 * start : 4 * (start + n)], total)
                        start += n
                yield _rows(bins.done, part)
                bins.done = []
        yield _rows([p for pieces in bins.open.values() for p in pieces], part)

    rows = base.whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id")
    pieces = base.store(rows.mapInArrow(base.trimmed(fill), PIECES), "pieces")
    done = [pieces.where("sequence_id IS NOT NULL")]
    # pandas has no nulls among longs: whether there is an id stands beside it.
    left = pieces.where("sequence_id IS NULL").withColumns({"named": F.col("doc_id").isNotNull(), "doc_id": F.coalesce("doc_id", F.lit(0))})
    parts = (pieces.agg(F.max("part")).head()[0] or 0) + 1
    level = 1
    while True:
        parts = -(-parts // FAN_IN)
        last = parts == 1
        found = left.withColumn("part", F.floor(F.col("part") / FAN_IN)).groupBy("part").applyInPandas(_level(level, capacity, classes, last), PIECES + ", named boolean")
        named = F.when(F.col("named"), F.col("doc_id")).alias("doc_id")
        if last:
            done.append(found.select(named, *COLUMNS[1:]))
            break
        found = base.store(found, f"left-{level}")
        done.append(found.where("sequence_id IS NOT NULL").select(named, *COLUMNS[1:]))
        left, level = found.where("sequence_id IS NULL"), level + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def _level(level: int, capacity: int, classes: int, last: bool) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def group(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        out = repack(rows, (level << 58) + (int(key[0]) << 32), capacity, classes, last)
        out["sequence_id"] = out["sequence_id"].astype("Int64").where(out["sequence_id"] >= 0)
        out["part"] = int(key[0])
        return out[[*COLUMNS, "named"]]

    return group


def _rows(pieces: list[list], part: int) -> pa.RecordBatch:
    columns = list(zip(*pieces, strict=True)) if pieces else [[] for _ in range(8)]
    kinds = [pa.int64()] * 5 + [pa.int32()] + [pa.int64()] * 2
    arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, pa.array(np.full(len(pieces), part, np.int64))], names=COLUMNS)
