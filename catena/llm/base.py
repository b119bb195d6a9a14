"""What the corpus operators share: shared storage, word arrays, hashing, tokenizers.

Nothing here gathers rows on the driver.  Tables that cut lineage go to the shared folder (``catena.storage``).
"""

from __future__ import annotations

import ctypes
import gc
import os
import re
import uuid
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catena import storage
from catena.storage import store as store

#: Runs of these characters separate words (space, tab, newline, VT, FF, CR).
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Text that a Python step holds as arrays at once; a longer text is held alone.
SLICE_BYTES = 4 << 20


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is created yet."""
    return f"{storage.folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path of a URI, on the driver or an executor; s3a and s3n are Hadoop's names of s3."""
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    if "://" not in uri:
        return pafs.LocalFileSystem(), os.path.abspath(uri)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


@lru_cache(maxsize=1)
def one_thread() -> None:
    """Keep numpy's matrix library to one thread in this process: products here are small, and more threads mostly wait for each other.

    Linux tells which library is loaded; elsewhere nothing is changed.
    """
    try:
        with open("/proc/self/maps") as f:
            loaded = {line.split()[-1] for line in f if "openblas" in line}
    except OSError:
        return
    for path in loaded:
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if put := getattr(library, name, None):
                put(1)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def trimmed(step: Step) -> Step:
    """The step, on one thread, which hands free memory back to the system when it ends: the worker process is kept for later stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        try:
            yield from step(batches)
        finally:
            trim()

    return run


def trim() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim_heap := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim_heap(0)


def with_long(df: DataFrame, column: str) -> DataFrame:
    """The column as a long; a table where it is one already stays as it is, so that plans that read it twice look the same."""
    return df if dict(df.dtypes)[column] == "bigint" else df.withColumn(column, F.col(column).cast("long"))


def whole_text(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """Only the named columns and the text, nulls as the empty string."""
    return docs.select(*keep, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def sample(rows: DataFrame, n: int, most: int, *keys: str) -> DataFrame:
    """At most ``most`` of ``n`` rows, picked by a hash of their keys: the same ones each run.

    The hash first leaves about twice as many as are wanted, so what tasks hand to the driver is bounded, too.
    """
    key = F.xxhash64(*keys)
    if 2 * most < n:
        rows = rows.where(F.pmod(key, F.lit(1 << 30)) < int((1 << 30) * 2 * most / n))
    return rows.orderBy(key, *keys).limit(most)


#: Text that is tokenized at once: more of it has fewer distinct words for its length.
TOKEN_SLICE_BYTES = 8 << 20


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch by bytes of text, so that memory does not depend on row length alone."""
    if not batch.num_rows:
        return
    size = np.asarray(pc.binary_length(batch.column(column)).fill_null(0), dtype=np.int64)
    group = (np.cumsum(size) - size) // limit
    cuts = np.flatnonzero(np.diff(group)) + 1
    for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
        yield batch.slice(lo, hi - lo)


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Offsets of each text's words, and the words of all texts in one array."""
    parts = pc.ascii_split_whitespace(texts)
    words, offsets = parts.flatten(), parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = np.asarray(pc.binary_length(words), dtype=np.int64) > 0
    if not full.all():
        count = np.concatenate([[0], np.cumsum(full)])
        offsets, words = count[offsets], words.filter(pa.array(full))
    return offsets, words


def coded_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Offsets, a code for each word, and the distinct words by code."""
    offsets, words = split_words(texts)
    coded = words.dictionary_encode()
    return offsets, np.asarray(coded.indices, dtype=np.int64), coded.dictionary


def word_hashes(distinct: pa.Array) -> np.ndarray:
    """64-bit hashes of the distinct words of a batch."""
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(w) for w in distinct.cast(pa.binary()).to_pylist()), np.uint64, len(distinct))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (SplitMix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def group_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of the runs between offsets; empty runs give 0."""
    total = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices ``start .. start + length - 1`` of all runs, one after another."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class CachedEncoder:
    """Whole-text ids of a public tokenizer file, by way of its distinct words.

    A text is cut where its tokenizer always cuts: before a space that follows
    a non-space (``lead_space``: byte-level vocabularies, whose words carry
    their leading space), or at every space (vocabularies that drop white space).
    The library encodes each distinct part of a batch once, many of them joined
    by a separator that no part contains and that no merge crosses.  Parts that
    came twice in a batch are kept for the next ones, ``capacity`` of them at
    most.  Texts that hold the string of an added token are encoded whole by the
    library, which makes special ids of such strings; if ``ordinary`` they are text like any other.
    """

    #: Parts of this form (RE2) can be joined: no separator, and no white space but a leading space and newlines inside.
    JOINABLE = r"^ ?[^~\s\x0b\x1c-\x1f\x85\p{Z}]+(\n+[^~\s\x0b\x1c-\x1f\x85\p{Z}]+)*$"

    def __init__(self, path: str, lead_space: bool, ordinary: bool = False, capacity: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = ordinary
        added = self.model.get_added_tokens_decoder().values()
        self.added = [(t.content, t.normalized) for t in added if not (ordinary and t.special)]
        self.lead_space, self.capacity = lead_space, capacity
        self.separator = "\t" if lead_space else " ~ "
        self.mark = self.model.encode(self.separator, add_special_tokens=False).ids
        self.kept = pa.array([], pa.string())
        self.count, self.flat = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32)

    def _one_by_one(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = list(self._encoded(parts.to_pylist(), 1024))
        count = np.fromiter(map(len, found), np.int64, len(found))
        return count, np.concatenate([*found, np.zeros(0, dtype=np.uint32)])

    def _encoded(self, texts: list[str], at_once: int) -> Iterator[np.ndarray]:
        """The ids of each text; what the library holds besides them is held for a few texts only."""
        for lo in range(0, len(texts), at_once):
            for x in self.model.encode_batch_fast(texts[lo : lo + at_once], add_special_tokens=False):
                yield np.array(x.ids, dtype=np.uint32)

    def _joined(self, parts: pa.Array, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
        cuts = pa.array([*range(0, len(parts), step), len(parts)], pa.int32())
        texts = [t + self.separator for t in pc.binary_join(pa.ListArray.from_arrays(cuts, parts), self.separator).to_pylist()]
        ids = np.concatenate(list(self._encoded(texts, 16)))
        ends = ids == self.mark[0]
        if len(self.mark) != 1 or int(ends.sum()) != len(parts):
            return self._one_by_one(parts)
        return np.diff(np.concatenate([[-1], np.flatnonzero(ends)])) - 1, ids[~ends]

    def _encode_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each part, and all ids in order."""
        simple = np.asarray(pc.match_substring_regex(parts, self.JOINABLE), dtype=bool)
        count, found = np.zeros(len(parts), dtype=np.int64), []
        for which, how in ((simple, self._joined), (~simple, self._one_by_one)):
            if which.any():
                count[which], ids = how(parts.filter(pa.array(which)))
                found.append((which, ids))
        start = np.cumsum(count) - count
        out = np.zeros(int(count.sum()), dtype=np.uint32)
        for which, ids in found:
            out[spread(start[which], count[which])] = ids
        return count, out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of each text's ids, and the ids of all texts (uint32)."""
        odd = np.zeros(len(texts), dtype=bool)
        for content, normalized in self.added:
            odd |= np.asarray(pc.match_substring(texts, content, ignore_case=normalized), dtype=bool)
        if not odd.any():
            return self._cut(texts)
        offsets, ids = self._cut(pc.if_else(pa.array(odd), "", texts))
        count, special = self._one_by_one(texts.filter(pa.array(odd)))
        n = np.diff(offsets)
        n[odd] = count
        at = np.concatenate([[0], np.cumsum(n)])
        out = np.zeros(int(at[-1]), dtype=np.uint32)
        for which, found in ((~odd, ids), (odd, special)):
            out[spread(at[:-1][which], n[which])] = found
        return at, out

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The same for texts without added tokens."""
        whole = pc.split_pattern(texts, " ")
        offsets, parts = whole.offsets.to_numpy().astype(np.int64), whole.flatten()
        offsets = offsets - offsets[0]
        if self.lead_space:
            # A part after the first one of its text begins with the space that was cut.
            first = np.zeros(len(parts), dtype=bool)
            first[offsets[:-1][np.diff(offsets) > 0]] = True
            runs = np.asarray(pc.match_substring(texts, "  "))
            spaced = pc.binary_join_element_wise("", parts, " ")
            parts = pc.if_else(pa.array(first), parts, spaced)
            if runs.any():
                return self._mixed(texts, runs, offsets, parts)
        return self._ids(offsets, parts)

    def _mixed(self, texts: pa.Array, runs: np.ndarray, offsets: np.ndarray, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Texts with runs of spaces are cut only where a run begins."""
        cut = re.compile(r"(?<=\S)(?= )")
        out, where = [], [0]
        for i, odd in enumerate(runs.tolist()):
            out += cut.split(texts[i].as_py()) if odd else parts[offsets[i] : offsets[i + 1]].to_pylist()
            where.append(len(out))
        return self._ids(np.array(where, dtype=np.int64), pa.array(out, pa.string()))

    def _ids(self, offsets: np.ndarray, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = parts.dictionary_encode()
        distinct, code = coded.dictionary, np.asarray(coded.indices)
        if not len(distinct):
            return np.zeros(len(offsets), dtype=np.int64), np.zeros(0, dtype=np.uint32)
        place = np.asarray(pc.index_in(distinct, value_set=self.kept).fill_null(-1), dtype=np.int64)
        new = np.flatnonzero(place < 0)
        place[new] = len(self.kept) + np.arange(len(new))
        missing = distinct.take(pa.array(new))
        count, ids = self._encode_parts(missing) if len(new) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint32))
        counts, flat = np.concatenate([self.count, count]), np.concatenate([self.flat, ids])
        row = place[code]
        each = counts[row]
        start = np.cumsum(counts) - counts
        out = flat[spread(start[row], each)]
        again = np.flatnonzero(np.bincount(code, minlength=len(distinct))[new] > 1)[: self.capacity - len(self.kept)]
        if len(again):
            self.kept = pa.concat_arrays([self.kept, missing.take(pa.array(again))])
            self.flat = np.concatenate([self.flat, ids[spread((np.cumsum(count) - count)[again], count[again])]])
            self.count = np.concatenate([self.count, count[again]])
        return np.concatenate([[0], np.cumsum(each)])[offsets], out


@lru_cache(maxsize=4)
def encoder(path: str, lead_space: bool, ordinary: bool = False) -> CachedEncoder:
    """One encoder for each worker process and file."""
    return CachedEncoder(path, lead_space, ordinary)


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file on this machine: a path, or the name of a public one."""
    if "/" in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def id_width(tokenizer: str) -> int:
    """Bytes that every id of a vocabulary fits in: 2 or 4."""
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(tokenizer_path(tokenizer))
    return 2 if max(model.get_vocab(with_added_tokens=True).values()) < 1 << 16 else 4
