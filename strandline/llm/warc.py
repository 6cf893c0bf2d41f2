"""WARC archives as a table of chunks.

``write`` makes one record of every row and ``chunks`` reads archives as rows (record, chunk number, bytes, digest so
far). Neither holds a whole payload in Python: the writer gets payloads already cut into chunks, the reader inflates
and hashes a chunk at a time, so memory is bounded by ``chunk_bytes`` whatever a record's length.

Files are gzip members, one for each record, rolled at ``file_bytes`` so that one read task has a bounded share. A
write task names its files anew on each attempt and reports those it finished; only reported files are read, so lost
executors and retries leave at most unread files. The report itself is a written table.

Payloads that are equal (by SHA-256) and at least ``revisit_bytes`` long are stored once, in the record of the largest
id; the others become ``revisit`` records that name it and carry its digest and length in their headers.

Edge cases: a null payload is an empty one; a null id sorts before all others and is written as an empty id; rows that
repeat a whole id and payload are each records of the same type; an empty table gives no file and no row; extra
columns of the input are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import util

CHUNKS = (
    "record_id long, record_type string, refers_to long, target_uri string, payload_bytes long, chunk_no long, chunk binary, "
    "sha1_so_far string, bytes_so_far long, is_last boolean, header_digest string"
)
CRLF = b"\r\n"


def _open(path: str, mode: str):
    """A stream by Arrow's file systems, which know local, HDFS and object stores alike."""
    from pyarrow import fs

    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    if mode == "w":
        system.create_dir(at.rpartition("/")[0], recursive=True)
        return system.open_output_stream(at, compression=None)
    return system.open_input_stream(at, compression=None)


def plan(rows: DataFrame, id_col: str, payload: Column, uri: Column, revisit_bytes: int = 1000) -> DataFrame:
    """record_id, uri, payload (binary), sha1, n_bytes, refers_to (null for responses)."""
    body = F.encode(F.coalesce(payload, F.lit("")), "UTF-8")
    rows = rows.select(F.col(id_col).cast("long").alias("record_id"), F.coalesce(uri, F.lit("")).alias("uri"), body.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "sha256": F.unhex(F.sha2("payload", 256)), "n_bytes": F.octet_length("payload").cast("long")})
    long = F.col("n_bytes") >= revisit_bytes
    first = rows.where(long).groupBy("sha256").agg(F.max("record_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = util.save(first, "warc-repeated")
    # payloads that are too short to be revisited have a key of their own, so a common short one is no common key
    rows = rows.withColumn("sha256", F.when(long, F.col("sha256")).otherwise(F.unhex(F.sha2(F.concat_ws(":", "record_id", "uri"), 256))))
    refers = F.when(F.coalesce(F.col("record_id"), F.lit(-(2**63))) < F.col("first_id"), F.col("first_id"))
    return util.attach(rows, first, ["sha256"], "n", ["record_id", "uri"]).select("record_id", "uri", "payload", "sha1", "n_bytes", refers.alias("refers_to"))


def chunked(records: DataFrame, chunk_bytes: int) -> DataFrame:
    """A row for each chunk of each payload; revisits have one empty chunk."""
    kept = F.when(F.col("refers_to").isNull(), F.col("n_bytes")).otherwise(0)
    last = F.greatest(F.lit(0), F.floor((kept - 1) / chunk_bytes))
    rows = records.select("*", kept.alias("kept"), F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("chunk_no"))
    piece = F.substring(F.col("payload"), F.col("chunk_no") * chunk_bytes + 1, F.least(F.lit(chunk_bytes), F.col("kept").cast("int")))
    return rows.select("record_id", "uri", "sha1", "n_bytes", "refers_to", "kept", "chunk_no", F.when(F.col("kept") > 0, piece).otherwise(F.lit(b"")).alias("chunk"))


def _header(r: dict) -> bytes:
    digest = base64.b32encode(bytes.fromhex(r["sha1"])).decode()
    lines = [
        "WARC/1.1",
        "WARC-Type: " + ("response" if r["refers_to"] is None else "revisit"),
        f"WARC-Record-ID: <urn:record:{'' if r['record_id'] is None else r['record_id']}>",
        "WARC-Target-URI: " + " ".join(r["uri"].split()),
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {r['kept']}",
    ]
    if r["refers_to"] is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:record:{r['refers_to']}>",
            f"X-Payload-Length: {r['n_bytes']}",
        ]
    return "\r\n".join(lines).encode() + CRLF * 2


def write(records: DataFrame, folder: str, chunk_bytes: int = 1 << 16, file_bytes: int = 1 << 27, level: int = 1) -> DataFrame:
    """Write the records of :func:`plan` as ``folder/*.warc.gz``; the table of files (path, n_records, n_bytes)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, member, size, n, path, left = [], None, None, 0, 0, "", 0
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                number = columns["chunk_no"][i].as_py()
                if number == 0:
                    r = {c: columns[c][i].as_py() for c in ("record_id", "uri", "sha1", "n_bytes", "refers_to", "kept")}
                    if out is not None and size >= file_bytes:
                        out.close()
                        done.append((path, n, size))
                        out = None
                    if out is None:
                        path, size, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = _open(path, "w")
                    member, left, n = zlib.compressobj(level, zlib.DEFLATED, 31), r["kept"], n + 1
                    size += out.write(member.compress(_header(r)))
                piece = columns["chunk"][i].as_buffer()
                size += out.write(member.compress(piece))
                left -= piece.size
                if left <= 0:
                    size += out.write(member.compress(CRLF * 2) + member.flush())
        if out is not None:
            out.close()
            done.append((path, n, size))
        yield pa.RecordBatch.from_arrays(
            [pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"]
        )

    return util.save(chunked(records, chunk_bytes).mapInArrow(task, "path string, n_records long, n_bytes long"), "warc-files")


class _Inflated:
    """Reads of a stream of gzip members, ``chunk`` bytes of input at a time."""

    def __init__(self, raw, chunk: int):
        self.raw, self.chunk, self.z, self.ready, self.rest = raw, chunk, None, bytearray(), b""

    def fill(self) -> bool:
        if not self.rest:
            self.rest = self.raw.read(self.chunk)
            if not self.rest:
                return False
        if self.z is None or self.z.eof:
            self.z = zlib.decompressobj(31)
        self.ready += self.z.decompress(self.rest, self.chunk)
        self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        return True

    def read(self, n: int) -> bytes:
        while len(self.ready) < n and self.fill():
            pass
        out = bytes(self.ready[:n])
        del self.ready[:n]
        return out

    def until(self, mark: bytes) -> bytes:
        """Up to and with ``mark``; what is left if there is none."""
        searched = 0
        while (k := self.ready.find(mark, max(0, searched - len(mark)))) < 0:
            searched = len(self.ready)
            if not self.fill():
                break
        return self.read(k + len(mark) if k >= 0 else len(self.ready))


def records_of(raw, chunk_bytes: int) -> Iterator[tuple]:
    """Rows of :data:`CHUNKS` of one archive."""
    stream = _Inflated(raw, chunk_bytes)
    number = lambda s: int(s.rpartition(":")[2].rstrip(">")) if s and s.rpartition(":")[2] != ">" else None
    while head := stream.until(CRLF * 2):
        if not head.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {head[:40]!r}")
        h = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:]) if k}
        left = int(h["content-length"])
        kind, digest = h["warc-type"], h.get("warc-payload-digest", "").removeprefix("sha1:")
        told = base64.b32decode(digest).hex() if digest else None
        sha, so_far, k = hashlib.sha1(), 0, 0
        while True:
            piece = stream.read(min(left, chunk_bytes))
            if len(piece) < min(left, chunk_bytes):
                raise ValueError("a WARC record ends before its Content-Length")
            left -= len(piece)
            sha.update(piece)
            so_far += len(piece)
            last = left == 0
            whole = int(h.get("x-payload-length", so_far)) if last else None
            yield number(h["warc-record-id"]), kind, number(h.get("warc-refers-to", "")), h.get("warc-target-uri", ""), whole, k, piece, sha.copy().hexdigest(), so_far, last, told
            k += 1
            if last:
                break
        stream.read(4)


def chunks(files: DataFrame, chunk_bytes: int = 1 << 16, batch_bytes: int = 1 << 22) -> DataFrame:
    """The chunk table of the archives in ``files`` (path). A record's last chunk has the digest of its whole payload.

    Of a revisit the one chunk is empty; header_digest and payload_bytes are those of the payload that it repeats.
    """
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_(), pa.string()]
    names = [x.split()[0] for x in CHUNKS.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                rows, size = [], 0
                with _open(path, "r") as raw:
                    for r in records_of(raw, chunk_bytes):
                        rows.append(r)
                        size += len(r[6]) + 300
                        if size >= batch_bytes:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    n = max(1, files.count())
    return files.select("path").repartitionByRange(min(n, 100_000), "path").mapInArrow(task, CHUNKS)


def summaries(table: DataFrame) -> DataFrame:
    """A row for each record of a chunk table: its length, digest, type and the record that it refers to."""
    digest = F.when(F.col("record_type") == "revisit", F.col("header_digest")).otherwise(F.col("sha1_so_far"))
    return table.where("is_last").select(
        "record_id", "target_uri", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to", (F.col("chunk_no") + 1).alias("n_chunks")
    )
