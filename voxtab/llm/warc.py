"""WARC archives, written from and read back as chunked record tables.

A record's payload is written and read `chunk_bytes` at a time: reading gives
rows of record id and chunk number with the digest of the payload so far, and no
task ever holds a whole archive or, on reading, a whole record. Records are
gzip members of their own, one archive per task. Archives lie in the shared
folder under names of their own; the manifest lists those of finished tasks only,
so a repeated task leaves an orphan at most.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxtab.llm.words import string_buffers
from voxtab.plans.leaders import with_leaders
from voxtab.plans.lineage import materialize, shared_dir

VERSION = b"WARC/1.1\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Fixed namespace of the record ids.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def record_id(page_id: int | None, digest: str) -> str:
    """The record id of a page with a payload."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}:{digest}')}>"


def _clean(value: str | None) -> str:
    return "".join(c for c in value or "" if c not in "\r\n")


def record_types(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """pages (page_id, url, html) with payload_bytes, payload_digest, and target: the page that a revisit refers to, else null.

    Of equal payloads of at least least_bytes the largest page_id is kept. Rows
    of that same page_id are all responses, and so are those of a payload that only
    rows with a null page_id have; a null html is an empty payload.
    """
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", "html", F.octet_length(body).cast("bigint").alias("payload_bytes"), F.sha1(body).alias("payload_digest"))
    large = F.col("payload_bytes") >= least_bytes
    same = rows.where(large).groupBy(F.col("payload_digest").alias("_digest"))
    kept = materialize(same.agg(F.max("page_id").alias("target"), F.count("*").alias("n")))
    found = with_leaders(rows.where(large).withColumn("_digest", F.col("payload_digest")), kept, "_digest")
    found = found.withColumn("target", F.when(~F.col("target").eqNullSafe(F.col("page_id")), F.col("target")))
    return found.unionByName(rows.where(~large).withColumn("target", F.lit(None).cast("bigint")))


def write_archives(records: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = 1 << 20) -> DataFrame:
    """Writes records (of record_types) as .warc.gz below folder; returns the manifest (path, records, bytes)."""

    def run(batches):
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, path, n = None, f"{base}/{uuid.uuid4().hex}.warc.gz", 0
        for b in batches:
            off, data = string_buffers(b.column(2))
            rest = zip(*[b.column(c).to_pylist() for c in (0, 1, 3, 4, 5)])
            for i, (page, url, size, digest, target) in enumerate(rest):
                if out is None:
                    out = store.open_output_stream(path, compression=None)
                http = HTTP.format(size).encode()
                head = {
                    "WARC-Type": "response" if target is None else "revisit",
                    "WARC-Record-ID": record_id(page, digest),
                    "WARC-Date": date,
                    "WARC-Target-URI": _clean(url),
                    "WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
                    **({} if page is None else {"Page-ID": page}),
                    "Content-Type": "application/http; msgtype=response",
                    "Content-Length": len(http) + (size if target is None else 0),
                }
                if target is not None:
                    head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": record_id(target, digest)}
                z = zlib.compressobj(6, wbits=31)
                text = "".join(f"{k}: {v}\r\n" for k, v in head.items())
                out.write(z.compress(VERSION + text.encode() + b"\r\n" + http))
                if target is None:
                    for lo in range(int(off[i]), int(off[i + 1]), chunk_bytes):
                        out.write(z.compress(data[lo : min(lo + chunk_bytes, int(off[i + 1]))]))
                out.write(z.compress(b"\r\n\r\n") + z.flush())
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n], "bytes": [size]})

    return records.select("page_id", "url", "html", "payload_bytes", "payload_digest", "target").mapInArrow(run, "path string, records bigint, bytes bigint")


class _Members:
    """Bytes of a stream of gzip members, a bounded piece at a time."""

    def __init__(self, stream, piece: int):
        self.stream, self.piece = stream, piece
        self.z, self.raw, self.plain = zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        while not self.plain:
            if self.z.eof:
                self.raw, self.z = self.z.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.stream.read(self.piece)
                if not self.raw:
                    return False
            self.plain += self.z.decompress(self.raw, self.piece)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw = b""  # what follows is in unused_data
        return True

    def read(self, n: int) -> bytes:
        """At most n bytes, and at least one unless the stream has ended."""
        if not self._more():
            return b""
        out = bytes(self.plain[:n])
        del self.plain[:n]
        return out

    def line(self) -> bytes:
        out = b""
        while not out.endswith(b"\n") and (x := self.read(1)):
            out += x
        return out

    def fields(self) -> dict[str, str]:
        """Header lines up to an empty one."""
        out = {}
        while (line := self.line().rstrip(b"\r\n")):
            name, _, value = line.decode("utf-8").partition(":")
            out[name.strip().lower()] = value.strip()
        return out


CHUNKS = "record_id string, page_id bigint, record_type string, refers_to_id string, declared_digest string, chunk int, is_last boolean, payload_bytes bigint, digest string, data binary"


def read_chunks(manifest: DataFrame, folder: str, chunk_bytes: int = 1 << 20, with_data: bool = True) -> DataFrame:
    """Rows of CHUNKS: per record, its payload in chunks (one empty chunk if it has none).

    payload_bytes and digest (hex SHA-1) are those of the payload up to and with
    the chunk; data is null unless asked for.
    """
    kinds = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to_id", pa.string()), ("declared_digest", pa.string()), ("chunk", pa.int32()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("digest", pa.string()), ("data", pa.binary())])

    def records(path, store):
        with store.open_input_stream(path, compression=None) as stream:
            m = _Members(stream, min(chunk_bytes, 1 << 16))
            while line := m.line():
                if not line.strip():
                    continue
                if line != VERSION:
                    raise ValueError(f"{path}: no record begins with {line[:40]!r}")
                head = m.fields()
                left = int(head["content-length"])
                while (line := m.line()) and left > 0:  # the block's HTTP header
                    left -= len(line)
                    if line == b"\r\n":
                        break
                sha, total, k = hashlib.sha1(), 0, 0
                declared = base64.b32decode(head["warc-payload-digest"].partition(":")[2]).hex()
                while True:
                    got = bytearray()
                    while left and len(got) < chunk_bytes and (x := m.read(min(left, chunk_bytes - len(got)))):
                        got += x
                        left -= len(x)
                    sha.update(got)
                    total += len(got)
                    yield head["warc-record-id"], int(head["page-id"]) if "page-id" in head else None, head["warc-type"], head.get("warc-refers-to"), declared, k, not left, total, sha.hexdigest(), bytes(got) if with_data else None
                    k += 1
                    if not left:
                        break

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for r in records(path, store):
                    rows.append(r)
                    held += 1 + len(r[-1] or b"") // 4096
                    if held >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)], schema=kinds)

    return manifest.select("path").mapInArrow(run, CHUNKS)


def archive_round_trip(pages: DataFrame, least_bytes: int = 1000, chunk_bytes: int = 1 << 20) -> DataFrame:
    """Writes pages (page_id, url, html) as archives and reads them back: one row per record.

    page_id, payload_bytes, payload_digest (as computed while reading; a
    revisit's are those of the record it refers to), record_type, refers_to,
    declared_digest, chunks. Payloads come as chunk rows, whose sizes are held
    against what the reader counted. A row with a null page_id has a record without
    that field, which revisits another one's but is revisited by none; rows that
    repeat a page_id are records of their own, and have one record id if their
    payloads agree too; other columns are not read. An empty table gives no records.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = materialize(write_archives(record_types(pages, least_bytes), folder, chunk_bytes=chunk_bytes))
    chunks = read_chunks(manifest.repartition(max(1, manifest.count()), "path"), folder, chunk_bytes)
    # What the reader counted and hashed must be what its chunks hold.
    held = chunks.withColumn("held", F.octet_length("data")).drop("data")
    records = held.groupBy("record_id", "page_id", "record_type", "refers_to_id", "declared_digest").agg(
        F.sum(F.when(F.col("chunk") == 0, 1).otherwise(0)).alias("copies"), F.sum("held").alias("held"), F.max(F.struct("chunk", "payload_bytes", "digest")).alias("end")
    )
    whole = F.col("held") == F.col("end.payload_bytes") * F.col("copies")
    records = records.withColumn("end", F.when(whole, F.col("end")).otherwise(F.raise_error(F.lit("a record's chunks do not add up"))))
    records = materialize(records.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("copy", "copies", "held"))
    own = records.where("record_type = 'response'").select("page_id", F.col("end.payload_bytes").alias("payload_bytes"), F.col("end.digest").alias("payload_digest"), "record_type", F.lit(None).cast("bigint").alias("refers_to"), "declared_digest", (F.col("end.chunk") + 1).alias("chunks"))
    revisits = records.where("record_type = 'revisit'")
    size = revisits.groupBy("refers_to_id").agg(F.count("*").alias("n"))
    kept = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_id"), F.col("page_id").alias("refers_to"), F.col("end.payload_bytes").alias("payload_bytes"), F.col("end.digest").alias("payload_digest"))
    kept = materialize(kept.join(size, "refers_to_id").dropDuplicates(["refers_to_id"]))
    again = with_leaders(revisits.select("page_id", "record_type", "declared_digest", "end", "refers_to_id"), kept, "refers_to_id")
    return own.unionByName(again.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "declared_digest", (F.col("end.chunk") + 1).alias("chunks")))
