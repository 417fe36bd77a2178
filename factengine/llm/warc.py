"""WARC archives written and read through an index (operator 8).

Writing yields an index first: archive, offset, length, URL and digest per record. Reading takes index rows, sorts them
by archive and offset, coalesces neighbouring byte ranges into one read, and parses the records of each read. Each
record is a gzip member of its own, so any range of whole records can be read alone.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factengine.llm.buckets import grouped
from factengine.llm.common import checked_broadcast, materialise, new_path, qualified

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string, payload_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
#: Bytes between two wanted records that are read along rather than skipped, and the most that one read takes.
GAP, MOST = 64 << 10, 8 << 20
DATE = "1970-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(text: str) -> str:
    """Header values are one line."""
    return re.sub(r"[\r\n]+", " ", text)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, serial: str) -> bytes:
    """One WARC/1.1 record: a response, or a revisit without a body if ``refers_to`` is given."""
    kind = "response" if refers_to is None else "revisit"
    heads = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, serial)}>"), ("WARC-Date", DATE)]
    if url is not None:
        heads.append(("WARC-Target-URI", _clean(url)))
    heads += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page_id is not None:
        heads.append(("X-Page-ID", str(page_id)))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if refers_to is not None:
        heads += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page", str(refers_to))]
        block = http
    else:
        block = http + payload
    heads += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict, bytes]]:
    """Headers and payload of each record in ``data``, a run of gzip members."""
    while data:
        member = zlib.decompressobj(31)
        raw = member.decompress(data) + member.flush()
        if not member.eof:
            raise ValueError("a record is cut off")
        data = member.unused_data
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        heads = dict(line.split(": ", 1) for line in lines[1:])
        block = rest[: int(heads["Content-Length"])]
        yield heads, block.partition(b"\r\n\r\n")[2]


def choose_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """``(page_id, url, html, refers_to)``: of records with equal payloads of at least ``least_bytes`` bytes the one with the
    largest id is the response, and ``refers_to`` of the others is that id. Null ids come before all others.

    Only payloads that occur again are looked up, by a broadcast of digests and ids up to a bound of rows."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).withColumn("key", F.unhex(F.sha1(F.col("html").cast("binary"))))
    groups = rows.select("key", "page_id", F.octet_length("html").alias("size")).where(F.col("size") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1").select("key", "last")
    refers = F.when(F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("page_id")), F.col("last"))
    return rows.join(checked_broadcast(materialise(groups, "groups"), 500_000), "key", "left").select("page_id", "url", "html", refers.alias("refers_to"))


def write_warc(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, **columns: str) -> DataFrame:
    """Writes a record per row of ``pages`` into gzipped archives in ``folder`` and returns the index.

    Each task writes one archive under a name of its own, so a task that runs again leaves an archive without index
    rows and never a broken one. ``folder`` is any URI that pyarrow's file systems know, or a path in the session's
    default file system; by default it lies in the session's shared folder. Rows that share a page id and a payload are all responses. Null HTML is an empty payload,
    null URLs give no target header. An empty table gives an empty index.
    """
    folder = qualified(pages.sparkSession, folder or new_path(pages.sparkSession, "warc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = fs.FileSystem.from_uri(folder)
        files.create_dir(path, recursive=True)
        name, out, at, serial = uuid.uuid4().hex, None, 0, 0
        try:
            for batch in batches:
                index: dict[str, list] = {c: [] for c in ("archive", "offset", "length", "url", "digest", "page_id", "record_type", "payload_bytes")}
                for page, url, html, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to")), strict=True):
                    payload = html.encode("utf-8", "surrogatepass")
                    digest = base32_sha1(payload)
                    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                    data = packer.compress(record_bytes(page, url, payload, digest, refers, f"{name}/{serial}")) + packer.flush()
                    out = out or files.open_output_stream(f"{path}/{name}.warc.gz", compression=None)
                    out.write(data)
                    for c, v in zip(index, (f"{name}.warc.gz", at, len(data), url, digest, page, "response" if refers is None else "revisit", len(payload)), strict=True):
                        index[c].append(v)
                    at += len(data)
                    serial += 1
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(index.values(), kinds, strict=True)], list(index))
        finally:
            if out:
                out.close()

    index = materialise(choose_revisits(pages, least_bytes=least_bytes, **columns).mapInArrow(run, INDEX), "index")
    return index.withColumn("folder", F.lit(folder))


def ranges(rows: list[tuple[int, int]], gap: int = GAP, most: int = MOST) -> list[tuple[int, int, int, int]]:
    """``(first row, last row + 1, start, end)`` of the reads that cover sorted ``(offset, length)`` rows."""
    out: list[tuple[int, int, int, int]] = []
    for i, (offset, length) in enumerate(rows):
        if out and offset - out[-1][3] <= gap and offset + length - out[-1][2] <= most:
            first, _, start, end = out[-1]
            out[-1] = (first, i + 1, start, max(end, offset + length))
        else:
            out.append((i, i + 1, offset, offset + length))
    return out


def read_warc(index: DataFrame, payload: bool = True) -> DataFrame:
    """The records of the index rows, in the schema ``RECORD``; ``payload=False`` leaves payloads null.

    Index rows are dealt out by slices of archives and sorted by offset. Payloads of responses are checked against
    their digests; a mismatch or a cut record is an error.
    """
    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = index.select("folder", "archive", "offset", "length", "digest", F.floor(F.col("offset") / MOST).alias("slice"))
    dealt = dealt.repartition(parts, "folder", "archive", "slice").sortWithinPartitions("folder", "archive", "slice", "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (folder, archive, _), rows in grouped(batches, ("folder", "archive", "slice"), ("offset", "length", "digest")):
            files, path = fs.FileSystem.from_uri(folder)
            with files.open_input_file(f"{path}/{archive}") as source:
                where = list(zip(rows["offset"], rows["length"], strict=True))
                for first, last, start, end in ranges(where):
                    data = source.read_at(end - start, start)
                    out: list[list] = [[] for _ in range(7)]
                    for i in range(first, last):
                        offset, length = where[i]
                        ((heads, body),) = parse_records(data[offset - start : offset - start + length])
                        digest, size = heads["WARC-Payload-Digest"].removeprefix("sha1:"), int(heads["X-Payload-Length"])
                        if digest != rows["digest"][i] or heads["WARC-Type"] == "response" and (base32_sha1(body) != digest or len(body) != size):
                            raise ValueError(f"{archive} at {offset}: the payload does not match its digest")
                        page, refers = heads.get("X-Page-ID"), heads.get("X-Refers-To-Page")
                        values = (page and int(page), heads.get("WARC-Target-URI"), heads["WARC-Type"], refers and int(refers), digest, size, body if payload and refers is None else None)
                        for column, v in zip(out, values, strict=True):
                            column.append(v)
                    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds, strict=True)], ["page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])

    return dealt.mapInArrow(run, RECORD)
