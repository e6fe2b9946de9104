"""WARC archives: a writer with de-duplicated payloads, and a splittable reader.

Archives are gzip files with one member per record. A reading task scans a
range of bytes for the gzip magic, takes a place as a member only if what it
decodes to starts with a WARC header, and owns the members that start inside
its range; a member may end beyond it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, delete, shared_dir

LEAST_REVISIT = 100
SPLIT = 8 << 20
#: Reading tasks per core, at most; a task reads several ranges of a large archive.
WAVES = 16
#: Fixed values of the format.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path on it."""
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", path)
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def record_bytes(page_id, url, html: bytes, digest: str, first) -> bytes:
    """One record: a response with its payload, or a revisit that names the page it repeats."""
    head = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", "_", url)))
    head.append(("WARC-Payload-Digest", f"sha256:{digest}"))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(html)}\r\n\r\n".encode()
    body = http + html if first is None else http
    if first is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{first}>")]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + body + b"\r\n\r\n"


def write_warc(pages: DataFrame, folder: str) -> DataFrame:
    """Write every row of ``pages`` (page_id, url, html) as a record; returns the files.

    Of the records with equal payloads of at least 100 bytes the one with the
    smallest page_id is a response and the others are revisits of it; smaller
    payloads are always responses. Null html counts as empty; a null url is
    left out; rows with a null page_id are responses of their own. Repeated
    rows of the smallest page_id are all responses. Other columns are ignored.

    Each task writes a file of its own under a new name and reports it when it
    is whole, so a task that runs again leaves at most a file that the returned
    list (path, size, records) does not name.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    firsts = rows.where(F.octet_length("html") >= LEAST_REVISIT).where("page_id is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = cut(firsts.where("n > 1").select("digest", "first"))
    rows = rows.join(firsts, "digest", "left").withColumn("first", F.when(F.col("page_id") > F.col("first"), F.col("first")))

    def run(batches):
        store, at = file_system(folder)
        store.create_dir(at, recursive=True)
        path, size, n, out = f"{at}/{uuid.uuid4().hex}.warc.gz", 0, 0, None
        for batch in batches:
            for page_id, url, html, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "first")), strict=True):
                out = out or store.open_output_stream(path, compression=None)
                packer = zlib.compressobj(1, zlib.DEFLATED, 31)
                member = packer.compress(record_bytes(page_id, url, html.encode("utf-8", "surrogatepass"), digest, first)) + packer.flush()
                out.write(member)
                size, n = size + len(member), n + 1
        if out:
            out.close()
            full = f"{folder.rstrip('/')}/{path.rpartition('/')[2]}"
            yield pa.RecordBatch.from_pydict({"path": pa.array([full]), "size": pa.array([size], pa.int64()), "records": pa.array([n], pa.int64())})

    return cut(rows.mapInArrow(run, "path string, size long, records long"))


class Range:
    """Bytes of a file from ``start`` on, read ahead in pieces."""

    def __init__(self, file, start: int, size: int, piece: int = 1 << 20):
        self.file, self.at, self.size, self.piece, self.data = file, start, size, piece, b""

    def fill(self, n: int) -> bool:
        """Hold at least ``n`` bytes, if the file has them; False at its end."""
        while len(self.data) < n and self.at + len(self.data) < self.size:
            self.file.seek(self.at + len(self.data))
            self.data += self.file.read(max(self.piece, n - len(self.data)))
        return len(self.data) >= n

    def skip(self, n: int) -> None:
        self.data, self.at = self.data[n:], self.at + n


def is_member(view: Range) -> bool:
    """Whether the bytes at hand are a gzip member whose content starts as a WARC record."""
    view.fill(4096)
    try:
        return zlib.decompressobj(31).decompress(view.data[:4096], 64).startswith(b"WARC/1.")
    except zlib.error:
        return False


def members(file, size: int, start: int, end: int):
    """(offset, content) of the members that start in [start, end)."""
    view = Range(file, start, size)
    while view.at < end:
        view.fill(1 << 16)
        place = view.data.find(MAGIC)
        if place < 0:
            if not view.data or view.at + len(view.data) >= size:
                return
            view.skip(max(1, len(view.data) - len(MAGIC) + 1))
            continue
        view.skip(place)
        if view.at >= end:
            return
        if not is_member(view):
            view.skip(1)
            continue
        offset, packer, parts = view.at, zlib.decompressobj(31), []
        while not packer.eof:
            if not view.fill(1):
                raise ValueError(f"the member at {offset} has no end")
            data = view.data
            parts.append(packer.decompress(data))
            view.skip(len(data) - len(packer.unused_data))
        yield offset, b"".join(parts)


def records(content: bytes):
    """(headers, block) of every record of a member."""
    at = 0
    while at < len(content):
        stop = content.find(b"\r\n\r\n", at)
        if stop < 0 or not content.startswith(b"WARC/1.", at):
            raise ValueError("not a WARC record")
        head = {}
        for line in content[at:stop].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            head[name.strip().lower()] = value.strip()
        n = int(head["content-length"])
        yield head, content[stop + 4 : stop + 4 + n]
        at = stop + 4 + n + 4


READ = "path string, offset long, record_type string, record_id string, target_uri string, refers_to string, digest string, payload_bytes long, payload binary"


def read_warc(spark: SparkSession, files: DataFrame, split: int = SPLIT, payloads: bool = True) -> DataFrame:
    """One row per record of ``files`` (path, size), read in ranges of ``split`` bytes.

    ``digest`` is computed from a response's payload and is the stated one for
    a revisit; ``payload_bytes`` is the full payload's size for either.
    ``payload`` is null for revisits and where ``payloads`` is False. Empty
    files have no records.
    """
    ranges = files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split).cast("long"))).alias("start"))
    count = max(1, files.agg(F.sum(F.ceil(F.col("size") / split))).first()[0] or 1)
    count = min(count, WAVES * spark.sparkContext.defaultParallelism)

    def run(batches):
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start")), strict=True):
                store, at = file_system(path)
                rows = []
                with store.open_input_file(at) as file:
                    for offset, content in members(file, size, start, start + split):
                        for head, block in records(content):
                            http, _, payload = block.partition(b"\r\n\r\n")
                            if kind := head["warc-type"] == "response":
                                n, digest = len(payload), hashlib.sha256(payload).hexdigest()
                            else:
                                n, digest = int(re.search(rb"(?i)content-length: *(\d+)", http)[1]), head.get("warc-payload-digest", "").rpartition(":")[2]
                            rows.append((path, offset, head["warc-type"], head.get("warc-record-id"), head.get("warc-target-uri"), head.get("warc-refers-to"), digest, n, payload if kind and payloads else None))
                        if len(rows) >= (100 if payloads else 2000):
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    return ranges.repartition(int(count), "path", "start").mapInArrow(run, READ)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    fields = [x.split() for x in READ.split(", ")]
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` to archives and read them back: a row per page, without payloads.

    Archives in a ``folder`` of the caller stay; others are deleted once they are read.
    """
    spark, own = pages.sparkSession, not folder
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    got = read_warc(spark, write_warc(pages, folder), payloads=False)
    if own:
        got = cut(got)
        delete(spark, folder)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)>', 1) as long)")
    return got.select(number("record_id").alias("page_id"), "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


SQL = f"""WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, strlen(coalesce(html, ''))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= {LEAST_REVISIT} GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""
