"""Token ids as length-delimited binary records.

A file holds records one after another: the length of the data (8 bytes, little
endian), its masked checksum (4), the data, and the masked checksum of the
data (4).  Checksums are CRC-32C, masked by a rotation and a constant, as in
the widely used TFRecord framing, so its readers accept the files.
The data of a record is one document: a width byte (2 or 4 bytes an id), a byte
that tells whether the document has an id, the doc_id (8 bytes), then the ids.

Files are cut from a range partitioning by doc_id, so the order of files, and of
the records in each, is ascending.  A separate index table (Parquet) holds
file, offset, length and number of ids of each record for shuffled reads.
A file gets its name only when it is complete, and a task that runs again writes
the same bytes to the same name.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from catena.llm import base

#: The reflected Castagnoli polynomial and the mask's constant (fixed values of the format).
CASTAGNOLI = np.uint32(0x82F63B78)
MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<BBq")
LANE = 64
READ_BYTES = 8 << 20
INDEX = "doc_id long, file string, part int, offset long, length long, n_tokens long, local_start long"


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Effect of the low and the high half of 4 bytes on the checksum state."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ CASTAGNOLI, one >> 1)

    def shift(x: np.ndarray) -> np.ndarray:
        return one[x & 0xFF] ^ (x >> np.uint32(8))

    low = np.arange(65536, dtype=np.uint32)
    high = np.arange(65536, dtype=np.uint32) << np.uint32(16)
    for _ in range(4):
        low, high = shift(low), shift(high)
    return low, high


def _double(matrix: np.ndarray) -> np.ndarray:
    return _apply(matrix, matrix)


def _apply(matrix: np.ndarray, x: np.ndarray) -> np.ndarray:
    """A linear map over bits, given by the images of the 32 bits, of each value."""
    out = np.zeros_like(x)
    for bit in range(32):
        out ^= np.where((x >> np.uint32(bit)) & np.uint32(1), matrix[bit], np.uint32(0))
    return out


@lru_cache(maxsize=1)
def _zeros() -> list[np.ndarray]:
    """Maps that append 1, 2, 4, ... zero bytes to what a state has seen."""
    bits = np.uint32(1) << np.arange(32, dtype=np.uint32)
    for _ in range(8):
        bits = np.where(bits & 1, (bits >> 1) ^ CASTAGNOLI, bits >> 1).astype(np.uint32)
    found = [bits]
    while len(found) < 40:
        found.append(_double(found[-1]))
    return found


@lru_cache(maxsize=64)
def _by_byte(power: int) -> np.ndarray:
    """The map of ``_zeros()[power]`` as its values for each of the 4 bytes of a state."""
    out = np.zeros((4, 256), dtype=np.uint32)
    for place in range(4):
        for bit in range(8):
            out[place, (np.arange(256) >> bit) & 1 == 1] ^= _zeros()[power][8 * place + bit]
    return out


def _advance(power: int, x: np.ndarray) -> np.ndarray:
    """The states after ``2 ** power`` zero bytes more."""
    t = _by_byte(power)
    return t[0][x & np.uint32(0xFF)] ^ t[1][(x >> np.uint32(8)) & np.uint32(0xFF)] ^ t[2][(x >> np.uint32(16)) & np.uint32(0xFF)] ^ t[3][x >> np.uint32(24)]


def crc32c(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """CRC-32C of each run ``data[offsets[i]:offsets[i + 1]]`` of bytes.

    The runs are padded in front to whole lanes (leading zeros don't change a
    state that starts at 0), all lanes advance together, and the lanes of a run
    are folded pairwise.
    """
    size = np.diff(offsets)
    lanes = np.maximum(1, -(-size // LANE))
    # A power of two of lanes for each run, so that folding needs no remainders.
    wide = 1 << np.ceil(np.log2(lanes)).astype(np.int64)
    state = np.zeros(len(size), dtype=np.uint32)
    low, high = _tables()
    for width in np.unique(wide):
        rows = np.flatnonzero(wide == width)
        block = max(1, (32 << 20) // int(width * LANE))
        for at in range(0, len(rows), block):
            own = rows[at : at + block]
            buffer = np.zeros(len(own) * int(width) * LANE, dtype=np.uint8)
            n = size[own]
            buffer[base.spread((np.arange(len(own)) + 1) * int(width) * LANE - n, n)] = data[base.spread(offsets[own], n)]
            words = np.ascontiguousarray(buffer.view("<u4").reshape(-1, LANE // 4).T)
            crc = np.zeros(words.shape[1], dtype=np.uint32)
            for word in words:
                crc ^= word
                crc = low[crc & np.uint32(0xFFFF)] ^ high[crc >> np.uint32(16)]
            step = LANE.bit_length() - 1
            while len(crc) > len(own):
                crc = _advance(step, crc[0::2]) ^ crc[1::2]
                step += 1
            state[own] = crc
    start = np.full(len(size), 0xFFFFFFFF, dtype=np.uint32)
    for bit in range(int(size.max(initial=0)).bit_length()):
        use = (size >> bit) & 1 == 1
        start[use] = _advance(bit, start[use])
    return state ^ start ^ np.uint32(0xFFFFFFFF)


def masked(crc: np.ndarray) -> np.ndarray:
    """Rotate right by 15 bits and add the constant."""
    crc = crc.astype(np.uint32)
    return ((crc >> np.uint32(15)) | (crc << np.uint32(17))) + np.uint32(MASK_DELTA)


def frame(payloads: list[bytes]) -> tuple[bytes, np.ndarray]:
    """The records of some payloads as bytes, and the length of each record."""
    size = np.fromiter(map(len, payloads), np.int64, len(payloads))
    data = np.frombuffer(b"".join(payloads), dtype=np.uint8)
    checks = masked(crc32c(data, np.concatenate([[0], np.cumsum(size)])))
    heads = size.astype("<u8").tobytes()
    head_checks = masked(crc32c(np.frombuffer(heads, dtype=np.uint8), np.arange(len(size) + 1) * 8))
    parts: list[bytes] = []
    for i, payload in enumerate(payloads):
        parts += (heads[8 * i : 8 * i + 8], head_checks[i].astype("<u4").tobytes(), payload, checks[i].astype("<u4").tobytes())
    return b"".join(parts), size + 16


def unframe(data: bytes) -> list[bytes]:
    """The payloads of whole records; raises if a length or a checksum is wrong."""
    at, heads, payloads, wanted = 0, [], [], []
    while at < len(data):
        head = data[at : at + 12]
        size = int.from_bytes(head[:8], "little")
        end = at + 12 + size
        if len(head) < 12 or end + 4 > len(data):
            raise ValueError("a record is cut short")
        heads.append(head[:8])
        wanted.append((int.from_bytes(head[8:], "little"), int.from_bytes(data[end : end + 4], "little")))
        payloads.append(data[at + 12 : end])
        at = end + 4
    if payloads:
        size = np.fromiter(map(len, payloads), np.int64, len(payloads))
        found = masked(crc32c(np.frombuffer(b"".join(payloads), dtype=np.uint8), np.concatenate([[0], np.cumsum(size)])))
        lengths = masked(crc32c(np.frombuffer(b"".join(heads), dtype=np.uint8), np.arange(len(heads) + 1) * 8))
        want = np.array(wanted, dtype=np.int64)
        if (lengths != want[:, 0]).any() or (found != want[:, 1]).any():
            raise ValueError("a checksum is wrong")
    return payloads


def pack_ids(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    return HEAD.pack(width, doc_id is not None, doc_id or 0) + ids.astype(f"<u{width}").tobytes()


def unpack_ids(payload: bytes) -> tuple[int | None, np.ndarray]:
    width, named, doc_id = HEAD.unpack_from(payload)
    return doc_id if named else None, np.frombuffer(payload, dtype=f"<u{width}", offset=HEAD.size)


def write(docs: DataFrame, folder: str, tokenizer: str = "byte_bpe_50k.json", lead_space: bool = True, end_id: int = 0, ordinary: bool = False) -> DataFrame:
    """Encode every whole text, write the record files to ``folder``, return the index table.

    Texts are encoded by the library's plain call, which makes special ids of the strings of special tokens; if
    ``ordinary`` these are text like any other.  Whole texts of any length are encoded, each into one record.
    Null text counts as empty; ``end_id`` is appended to each document.  A null
    doc_id sorts first.  Rows that repeat a doc_id are records of their own, in an order that their texts decide;
    many such rows go to several files.
    Other columns are ignored; an empty table writes no file.  An id takes 2 bytes where the vocabulary allows it, else 4.
    """
    width = max(base.id_width(tokenizer), 2 if end_id < 1 << 16 else 4)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = base.encoder(base.tokenizer_path(tokenizer), lead_space, ordinary)
        fs, root = base.filesystem(folder)
        number = TaskContext.get().partitionId()
        name = f"{number:06d}.records"
        out, offset, start, temporary = None, 0, 0, f"{root}/.{name}.{uuid.uuid4().hex}"
        for whole in batches:
            for batch in base.slices(whole, limit=base.TOKEN_SLICE_BYTES):
                at, ids = model.encode(batch.column("text"))
                doc_ids = batch.column("doc_id").to_pylist()
                n = np.diff(at) + 1
                payloads = [pack_ids(d, np.append(ids[a:b], end_id), width) for d, a, b in zip(doc_ids, at[:-1], at[1:], strict=True)]
                data, length = frame(payloads)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary)
                out.write(data)
                where = np.cumsum(length) - length + offset
                before = np.cumsum(n) - n + start
                offset, start = offset + len(data), start + int(n.sum())
                same = len(doc_ids)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([name] * same), pa.array(np.full(same, number, np.int32)), pa.array(where), pa.array(length), pa.array(n), pa.array(before)], names=["doc_id", "file", "part", "offset", "length", "n_tokens", "local_start"])
        if out is not None:
            out.close()
            fs.move(temporary, f"{root}/{name}")

    # Equal ids (or none) are told apart by their texts, and equal rows by their places, so that no id fills a file alone.
    rows = base.whole_text(docs.withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id").withColumns({"tie": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange("doc_id", "tie", "place").sortWithinPartitions("doc_id", "tie", "place")
    return base.store(rows.select("doc_id", "text").mapInArrow(base.trimmed(part), INDEX), "record-index")


def read(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """The records that ``index`` (any rows of the index table) names, each once: doc_id, part, local_start, n_tokens, ids, ids_crc32.

    Selected records of about 8 MB of a file are read together, by one range; only they are returned.
    """
    return _ranges(index).mapInArrow(base.trimmed(lambda batches: _read(batches, folder, True)), "doc_id long, part int, local_start long, n_tokens long, ids array<int>, ids_crc32 long")


def _ranges(index: DataFrame) -> DataFrame:
    block = F.floor(F.col("offset") / READ_BYTES)
    # A block's list is bounded: a record has 26 bytes at least.
    own = F.sort_array(F.collect_set(F.struct("offset", "length", "local_start"))).alias("own")
    ranges = index.groupBy("file", "part", block.alias("block")).agg(own)
    # The table of ranges is small, so its number of tasks is set: adaptive execution would read everything in one.
    return ranges.repartition(max(1, min(ranges.count(), 100_000)), F.col("file"), F.col("block"))


def _read(batches: Iterator[pa.RecordBatch], folder: str, with_ids: bool) -> Iterator[pa.RecordBatch]:
    fs, root = base.filesystem(folder)
    for batch in batches:
        for file, part, own in zip(batch.column("file").to_pylist(), batch.column("part").to_pylist(), batch.column("own"), strict=True):
            offset, length, start = (np.asarray(own.values.field(c), dtype=np.int64) for c in ("offset", "length", "local_start"))
            with fs.open_input_file(f"{root}/{file}") as f:
                f.seek(int(offset[0]))
                data = f.read(int(offset[-1] + length[-1] - offset[0]))
            if int(length.sum()) != len(data):
                data = b"".join(data[a : a + n] for a, n in zip((offset - offset[0]).tolist(), length.tolist(), strict=True))
            found = [unpack_ids(p) for p in unframe(data)]
            n = np.fromiter((len(x[1]) for x in found), np.int64, len(found))
            crc = pa.array([zlib.crc32(x[1].astype("<u4").tobytes()) for x in found], pa.int64())
            columns = [pa.array([x[0] for x in found], pa.int64()), pa.array(np.full(len(found), part, np.int32)), pa.array(start), pa.array(n)]
            names = ["doc_id", "part", "local_start", "n_tokens"]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.concatenate([x[1] for x in found]).astype(np.uint32).view(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays([*columns, crc], names=[*names, "ids_crc32"])


def digest(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of all documents, from the files alone.

    ``start`` counts the ids of all documents before; the files' totals are
    summed first, one row a file.
    """
    found = base.store(_ranges(index).mapInArrow(base.trimmed(lambda batches: _read(batches, folder, False)), "doc_id long, part int, local_start long, n_tokens long, ids_crc32 long"), "records-read")
    files = found.groupBy("part").agg(F.sum("n_tokens").alias("in_file"))
    before = F.coalesce(F.sum("in_file").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return found.join(files.select("part", before.alias("file_start")), "part").select("doc_id", (F.col("file_start") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32")
