"""WARC archives: a writer on Spark's committed text sink and a splittable reader by byte ranges."""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.plans.materialize import materialize

LEAST_REVISIT_BYTES = 100
SPLIT_BYTES = 32 << 20
_MAGIC, _VERSION, _CHUNK = b"\x1f\x8b\x08", b"WARC/1.", 1 << 20
_EMPTY_MEMBER = gzip.compress(b"", mtime=0)
_DATE = "2020-01-01T00:00:00Z"


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_of(record_id: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", record_id or "")
    return int(m[1]) if m else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member with one WARC record; a revisit carries headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id)}", f"WARC-Date: {_DATE}", f"WARC-Target-URI: {quote(url or 'about:blank', safe='/:?#[]@!$&()*+,;=%~')}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def write_warc(pages: DataFrame, folder: str) -> None:
    """Writes ``pages (page_id, url, html)`` as ``*.warc.gz`` under ``folder``, one gzip member per record.

    Of rows with equal payloads of at least 100 bytes the one with the smallest page_id is the response and the others revisit
    it (rows repeating that page_id are responses too, as are null ids where no other exists); smaller payloads are always
    responses. A null html is an empty payload. Digests alone are grouped; the grouped table is stored, so that the join with
    the pages can split a frequent payload over tasks.

    Spark's text sink commits files atomically on any file system and adds a separator after each row. A gzip member ends
    with the high byte of its size, zero below 16 MiB: that byte is the separator. Larger records get an empty member added.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"digest": F.sha2("payload", 256), "size": F.octet_length("payload")})
    groups = rows.where(F.col("size") >= LEAST_REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = materialize(groups.where("n > 1").select("digest", "first"))
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    rows = rows.join(groups, "digest", "left").select("page_id", "url", "digest", "payload", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                members = []
                for r in batch.slice(k, 64).to_pylist():
                    member = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    members.append((member if member[-1] == 0 else member + _EMPTY_MEMBER)[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])

    members = rows.mapInArrow(run, "value binary").select(F.col("value").cast("string"))
    members.write.option("lineSep", "\0").option("encoding", "ISO-8859-1").text(folder)
    path, fs = _hadoop(pages.sparkSession, folder)
    for f in fs.listStatus(path):
        if f.getPath().getName().startswith("part-"):
            fs.rename(f.getPath(), f.getPath().suffix(".warc.gz"))


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def _open(uri: str):
    uri = re.sub(r"^file:/+", "file:///", uri)
    fs, path = pafs.FileSystem.from_uri(uri)
    return fs.open_input_file(path)


def _member(f, at: int) -> tuple[bytes, int] | None:
    """(content, end) of the gzip member at a byte offset, or None if none starts there that decodes to a WARC record."""
    f.seek(at)
    stream, out, read = zlib.decompressobj(31), io.BytesIO(), 0
    try:
        while not stream.eof:
            data = f.read(_CHUNK)
            if not data:
                return None
            read += len(data)
            out.write(stream.decompress(data))
            if out.tell() >= len(_VERSION) and out.getbuffer()[: len(_VERSION)] != _VERSION:
                return None
    except zlib.error:
        return None
    content = out.getvalue()
    return (content, at + read - len(stream.unused_data)) if content.startswith(_VERSION) else None


def records_in(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the records that start in [start, end); the last may reach beyond."""
    at = start
    while at < end:
        f.seek(at)
        window = f.read(min(_CHUNK, end - at + len(_MAGIC) - 1))
        k = window.find(_MAGIC)
        if k < 0:
            if len(window) < len(_MAGIC):  # the end of the file
                return
            at += len(window) - len(_MAGIC) + 1
            continue
        at += k
        if at >= end:
            return
        found = _member(f, at)
        if found is None:
            at += 1
        else:
            yield at, found[0]
            at = found[1]


def parse_record(content: bytes) -> dict:
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in head.decode().split("\r\n")[1:])}
    block = rest[: int(fields["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["warc-type"] == "revisit"
    return {
        "page_id": _page_of(fields["warc-record-id"]), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "payload": None if revisit else payload,
        "payload_bytes": int(fields["warc-payload-length"]) if revisit else len(payload),
        "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:") if revisit else hashlib.sha256(payload).hexdigest(),
        "refers_to": _page_of(fields.get("warc-refers-to")),
    }


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])


def read_warc(spark: SparkSession, folder: str, split_bytes: int = SPLIT_BYTES, payload: bool = True) -> DataFrame:
    """Records of all ``*.warc.gz`` under ``folder``: page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to, file, offset.

    A task scans one byte range for gzip magic, takes a candidate for a record if the member decodes to a WARC header, and owns
    the records that start inside its range, so one large file is read by many tasks. Revisits take size and digest from
    their headers; of responses both are computed from the payload.
    """
    path, fs = _hadoop(spark, folder)
    files = [(f.getPath().toString(), f.getLen()) for f in fs.listStatus(path) if f.getPath().getName().endswith(".warc.gz") and f.getLen()]
    n = sum(-(-size // split_bytes) for _, size in files)
    ranges = spark.createDataFrame(files, "file string, size bigint").select("file", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"))
    ranges = ranges.repartition(max(1, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows, size = [], 0
                with _open(r["file"]) as f:
                    for at, content in records_in(f, r["start"], r["start"] + split_bytes):
                        row = parse_record(content) | {"file": r["file"], "offset": at}
                        rows.append(row if payload else row | {"payload": None})
                        size += len(content)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _READ)
                            rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, _READ)

    return ranges.mapInArrow(run, "page_id bigint, url string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, file string, offset bigint")
