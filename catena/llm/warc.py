"""WARC archives, written with an index and read back by coalesced byte ranges.

The index (offset, length, URL, digest and more of each record) is what readers
start from: the selected records are sorted by file and offset, ranges with
small gaps between them are joined into one read, and records are cut from what was read.
Every record is a gzip member of its own, so any record can be read alone.

Of pages with equal payloads of at least ``least`` bytes, the one with the largest
id is written as a response and the others as revisits of it.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catena.llm import base

LEAST = 1000
#: Ranges up to this far apart are read together, up to this many bytes at once.
GAP, SPAN = 64 << 10, 8 << 20
INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def record_id(page_id: int | None, place: str) -> str:
    """The same name each time: of the page, or of the place in its file for pages without an id."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{place if page_id is None else page_id}')}>"


def header_value(text: str) -> str:
    """A value that stays on its line: control characters and line ends are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: "".join(f"%{b:02X}" for b in m.group().encode()), text)


def record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None, place: str) -> bytes:
    """One WARC/1.1 record; a revisit has the headers of its payload but not the payload."""
    body = HTTP if refers_to is not None else HTTP + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, place)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {header_value(url)}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, '')}", f"X-Refers-To-Page: {refers_to}", f"X-Payload-Length: {len(payload)}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    lines.append(f"Content-Length: {len(body)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """The fields of one record; raises if its length or its payload's digest is wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    body = rest[: int(fields["Content-Length"])]
    if not first.startswith("WARC/") or rest[len(body) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    sha1 = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    revisit = fields["WARC-Type"] == "revisit"
    payload = None if revisit else body.partition(b"\r\n\r\n")[2]
    if payload is not None and hashlib.sha1(payload).hexdigest() != sha1:
        raise ValueError("a payload does not match its digest")
    number = lambda k: int(fields[k]) if k in fields else None
    return {"page_id": number("X-Page-Id"), "url": fields.get("WARC-Target-URI"), "payload_bytes": number("X-Payload-Length") if revisit else len(payload), "payload_digest": sha1, "record_type": fields["WARC-Type"], "refers_to": number("X-Refers-To-Page"), "payload": payload}


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, digest, refers_to`` of the pages that repeat the payload of a page with a larger id."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    small = base.store(pages.select(F.col("page_id").cast("long"), F.sha1(html).alias("digest"), F.length(html).alias("bytes")).where(F.col("bytes") >= least).select("page_id", "digest"), "payload-digests")
    # Counts are summed before the shuffle; only repeated digests are joined back.
    best = small.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").select("digest", "refers_to")
    return small.join(best, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, folder: str, least: int = LEAST, level: int = 1) -> DataFrame:
    """Write a record for each page to ``folder`` and return the index table.

    Null html counts as empty; a null url leaves the header out; spaces and control characters of a url are percent-encoded, as a
    header is one line, and read back so.  Very long html is one record like any other; memory holds the page and its compressed form.  Pages without an id
    are responses.  Rows that repeat a page_id are records of their own (of equal payloads with one id all are responses).
    Other columns are ignored; an empty table writes no file.
    A file gets its name when it is complete, and a task that runs again writes the same file.
    """

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = base.filesystem(folder)
        name = f"{TaskContext.get().partitionId():06d}.warc.gz"
        temporary, out, offset = f"{root}/.{name}.{uuid.uuid4().hex}", None, 0
        for whole in batches:
            for batch in base.slices(whole):
                rows, found = batch.to_pylist(), []
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temporary)
                for r in rows:
                    payload = r["text"].encode()
                    sha1 = hashlib.sha1(payload).hexdigest()
                    data = gzip.compress(record(r["page_id"], r["url"], payload, sha1, r["refers_to"], f"{name}:{offset}"), level, mtime=0)
                    out.write(data)
                    found.append((r["page_id"], name, offset, len(data), r["url"], sha1, "response" if r["refers_to"] is None else "revisit"))
                    offset += len(data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], names=["page_id", "file", "offset", "length", "url", "digest", "record_type"])
        if out is not None:
            out.close()
            fs.move(temporary, f"{root}/{name}")

    again = revisits(pages, least)
    rows = base.whole_text(pages.withColumn("page_id", F.col("page_id").cast("long")), "page_id", F.col("url").cast("string").alias("url"), text="html")
    rows = rows.withColumn("digest", F.sha1(F.col("text").cast("binary"))).join(again, ["page_id", "digest"], "left").select("page_id", "url", "text", "refers_to")
    return base.store(rows.mapInArrow(base.trimmed(part), INDEX), "warc-index")


def ranges(offsets: np.ndarray, lengths: np.ndarray, gap: int = GAP, span: int = SPAN) -> list[tuple[int, int]]:
    """Begin and end of the reads that cover records given in ascending order of offset."""
    out: list[tuple[int, int]] = []
    for begin, size in zip(offsets.tolist(), lengths.tolist(), strict=True):
        end = begin + size
        if out and begin - out[-1][1] <= gap and end - out[-1][0] <= span:
            out[-1] = (out[-1][0], end)
        else:
            out.append((begin, end))
    return out


def read(spark: SparkSession, folder: str, selected: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``selected`` (rows of the index) names, each as one row.

    Blocks of a file go to different tasks, so one large archive is read in parallel.
    """

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = base.filesystem(folder)
        for batch in batches:
            files = batch.column("file").to_numpy(zero_copy_only=False)
            offsets, lengths = np.asarray(batch.column("offset")), np.asarray(batch.column("length"))
            for name in dict.fromkeys(files.tolist()):
                own = np.flatnonzero(files == name)
                own = own[np.argsort(offsets[own], kind="stable")]
                with fs.open_input_file(f"{root}/{name}") as f:
                    k = 0
                    for begin, end in ranges(offsets[own], lengths[own]):
                        f.seek(begin)
                        data, found = f.read(end - begin), []
                        while k < len(own) and offsets[own[k]] < end:
                            at = int(offsets[own[k]]) - begin
                            found.append(parse(zlib.decompress(data[at : at + int(lengths[own[k]])], 31)))
                            k += 1
                        yield _read_batch(found, payloads)

    block = F.floor(F.col("offset") / SPAN)
    rows = selected.select("file", "offset", "length", block.alias("block"))
    # The index is small beside what it points to, so the number of tasks is set by the blocks.
    n = rows.select("file", "block").distinct().count()
    sorted_rows = rows.repartition(max(1, min(n, 100_000)), "file", "block").sortWithinPartitions("file", "offset")
    schema = READ if payloads else READ.rpartition(",")[0]
    return sorted_rows.mapInArrow(base.trimmed(fetch), schema)


def _read_batch(found: list[dict], payloads: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()} | ({"payload": pa.binary()} if payloads else {})
    return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in kinds.items()], names=list(kinds))


#: DuckDB's form of what is read back, over pages with distinct ids.
SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""
