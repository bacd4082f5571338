"""WARC archives: a deterministic sharded writer and a reader.

Writer.  One narrow pass finds, per payload digest, the record that the others
revisit.  Records are then range-partitioned by id into shards of about equal payload
bytes and sorted: bytes are counted in up to ``CELLS`` cells of equal id width, runs of which make
a shard.  Shards depend on the rows alone, not on the cluster.  Each task streams its records, one gzip member each, into files that
roll once their compressed size reaches ``roll_bytes``.  Headers and digests are
generated from the payload; no clock, host or random number enters a file, so a
repeated task writes the same bytes.  A file is written under a temporary name and
renamed when complete, unless another attempt has already put the same file there;
what failed attempts leave goes with the temporary folder.  The manifest (file, records, bytes, SHA-256, first and last
id), written by Spark's own commit, names the files that count.

Reader.  Only files of the manifest are read, streamed member by member; a payload
that disagrees with its digest, or a file that ends early, raises.

Files are opened through ``pyarrow.fs`` by the folder's URI, in the tasks.

Defined results
* null html is an empty payload; bytes are the text's UTF-8 whatever it holds;
* of records with equal payloads of at least ``least`` bytes those with the largest
  id are responses (rows that repeat that id too), the others revisit it; a null id
  is the largest only if all are null;
* a null url is left out and reads back as null; an empty table writes no file and
  reads back as no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clausewright.llm.scratch import Scratch, below, pick

#: Compressed bytes at which a file is closed; payload bytes of a shard; least payload bytes of a revisit.
ROLL, SHARD, LEAST = 64 << 20, 16 << 20, 1000
#: Tasks that read archives, at most.
READERS = 100_000
#: Cells of ids whose bytes are counted: at most, and for a shard.
CELLS, CELLS_A_SHARD = 100_000, 8
#: Payloads found twice or more up to which their list is broadcast (about 60 bytes each).
BROADCAST_PAYLOADS = 500_000
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"
TEMPORARY = "_temporary"
MANIFEST = "file string, records long, bytes long, sha256 string, first_id long, last_id long"


def _digest(sha1: bytes) -> str:
    return "sha1:" + base64.b32encode(sha1).decode()


def _record(kind: str, head: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = [("WARC-Type", kind), *head, ("WARC-Date", DATE), ("WARC-Block-Digest", _digest(hashlib.sha1(block).digest())), ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + CRLF + block + CRLF + CRLF
    c = zlib.compressobj(6, zlib.DEFLATED, 31)
    return c.compress(raw) + c.flush()


def encode(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A page's record: the whole payload, or a revisit of another page's."""
    head = [("WARC-Record-ID", f"<urn:page:{page_id}>")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~%-._")))
        head.append(("X-Target-Escaped", quote(url, safe="")))
    head.append(("WARC-Payload-Digest", _digest(hashlib.sha1(payload).digest())))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head.append(("Content-Type", "application/http;msgtype=response"))
    if refers_to is None:
        return _record("response", head, http + payload)
    head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _record("revisit", head, http)


class Roller:
    """Files of one shard."""

    def __init__(self, uri: str, shard: int, roll: int):
        self.fs, self.root = fs.FileSystem.from_uri(uri)
        self.shard, self.roll, self.n, self.out = shard, roll, 0, None

    def add(self, page_id: int | None, data: bytes) -> Iterator[dict]:
        if self.out is None:
            self.name = f"shard-{self.shard:08d}-{self.n:05d}.warc.gz"
            self.temp = f"{self.root}/{TEMPORARY}/{uuid.uuid4().hex}-{self.name}"
            self.out = self.fs.open_output_stream(self.temp, compression=None)
            self.sha, self.row = hashlib.sha256(), {"file": self.name, "records": 0, "bytes": 0, "first_id": page_id}
            self._put(_record("warcinfo", [("WARC-Record-ID", f"<urn:file:{self.name}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self._put(data)
        self.row["records"] += 1
        self.row["last_id"] = page_id
        if self.row["bytes"] >= self.roll:
            yield self.close()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.row["bytes"] += len(data)

    def close(self) -> dict:
        self.out.close()
        final = f"{self.root}/{self.name}"
        if self.fs.get_file_info(final).type == fs.FileType.NotFound:
            self.fs.move(self.temp, final)  # else another attempt has written the same bytes
        self.out, self.n = None, self.n + 1
        return self.row | {"sha256": self.sha.hexdigest()}


def write(pages: DataFrame, uri: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", roll_bytes: int = ROLL, shard_bytes: int = SHARD, least: int = LEAST) -> DataFrame:
    """Write all rows below the folder ``uri``; returns the manifest, kept as Parquet in ``uri/manifest``."""
    spark = pages.sparkSession
    base = pick(pages, id=id_col, url=url_col, html=html_col).select(F.col("id").cast("long").alias("id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    base = base.withColumn("n", F.octet_length("payload")).withColumn("sha", F.sha1("payload"))
    work = Scratch(spark, "warc")
    narrow = work.keep(base.select("id", "n", "sha"))
    twice = work.keep(narrow.where(F.col("n") >= least).groupBy("sha").agg(F.count("*").alias("copies"), F.max("id").alias("target")).where("copies > 1").select("sha", "target"))
    spread = narrow.agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum("n").alias("bytes")).first()
    low, high, total = spread["low"] or 0, spread["high"] or 0, spread["bytes"] or 0
    shards = max(1, -(-total // shard_bytes))
    width = max(1, -(-(high - low + 1) // min(CELLS, CELLS_A_SHARD * shards)))
    cell = F.coalesce(F.floor((F.col("id") - F.lit(low)) / F.lit(width)).cast("int"), F.lit(0))
    sums = narrow.groupBy(cell.alias("cell")).agg(F.sum("n").alias("bytes"))  # at most CELLS rows
    ends = F.sum("bytes").over(Window.orderBy("cell")) - F.col("bytes")
    shard_of = work.keep(sums.select("cell", F.floor(ends / F.lit(shard_bytes)).cast("int").alias("shard")))
    rows = base.join(F.broadcast(twice) if below(twice, BROADCAST_PAYLOADS) else twice, "sha", "left")
    rows = rows.withColumn("cell", cell).join(F.broadcast(shard_of), "cell").select("shard", "id", "url", "payload", F.when(F.col("target") != F.coalesce("id", F.lit(-(2**63))), F.col("target")).alias("refers_to"), "sha")
    rows = rows.repartitionByRange(min(shards, 1_000_000), "shard").sortWithinPartitions("shard", "id", "url", "sha").drop("sha")
    folder, root = fs.FileSystem.from_uri(uri)
    folder.create_dir(f"{root}/{TEMPORARY}", recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, roller = [], None
        for b in batches:
            for s, i, url, payload, ref in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if roller is None or roller.shard != s:
                    if roller is not None and roller.out is not None:
                        done.append(roller.close())
                    roller = Roller(uri, s, roll_bytes)
                done += roller.add(i, encode(i, url, payload, ref))
        if roller is not None and roller.out is not None:
            done.append(roller.close())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], k) for n, k in zip(names, kinds, strict=True)], names)

    rows.mapInArrow(run, MANIFEST).write.parquet(f"{uri}/manifest")
    work.drop(narrow, twice, shard_of)
    folder.delete_dir(f"{root}/{TEMPORARY}")
    return spark.read.schema(MANIFEST).parquet(f"{uri}/manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a stream, one after another."""
    rest, parts, d = b"", [], zlib.decompressobj(31)
    while True:
        data = rest or stream.read(size)
        rest = b""
        if not data:
            if parts:
                raise ValueError("the archive ends within a record")
            return
        parts.append(d.decompress(data))
        if d.eof:
            yield b"".join(parts)
            rest, parts, d = d.unused_data, [], zlib.decompressobj(31)


def decode(record: bytes) -> dict | None:
    """What a record says; None for one that is no page."""
    at = record.index(CRLF + CRLF)
    head = dict(x.split(": ", 1) for x in record[:at].decode().split("\r\n")[1:])
    if head["WARC-Type"] not in ("response", "revisit"):
        return None
    block = record[at + 4 : at + 4 + int(head["Content-Length"])]
    split = block.index(CRLF + CRLF) + 4
    payload, n = block[split:], int(re.search(rb"Content-Length: (\d+)", block[:split])[1])
    sha1 = base64.b32decode(head["WARC-Payload-Digest"][5:])
    whole = head["WARC-Type"] == "response"
    if _digest(hashlib.sha1(block).digest()) != head["WARC-Block-Digest"] or whole and (len(payload) != n or hashlib.sha1(payload).digest() != sha1):
        raise ValueError(f"{head['WARC-Record-ID']} disagrees with its digest")
    page = lambda x: None if x == "<urn:page:None>" else int(x[10:-1])
    url = unquote(head["X-Target-Escaped"]) if "X-Target-Escaped" in head else None
    return {"id": page(head["WARC-Record-ID"]), "url": url, "payload_bytes": n, "payload_digest": sha1.hex(), "record_type": head["WARC-Type"], "refers_to": page(head["WARC-Refers-To"]) if "WARC-Refers-To" in head else None, "payload": payload if whole else None}


def read(spark: SparkSession, uri: str, with_payload: bool = True) -> DataFrame:
    """One row per page record: ``id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]``."""
    schema = "id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        folder, root = fs.FileSystem.from_uri(uri)
        for b in batches:
            for name in b.column(0).to_pylist():
                found, size = [], 0
                with folder.open_input_stream(os.path.join(root, name), compression=None) as f:
                    for record in members(f):
                        if (r := decode(record)) is not None:
                            found.append(r)
                            size += len(record) if with_payload else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], names)
                            found, size = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in found], t) for n, t in zip(names, types, strict=True)], names)

    files = spark.read.schema(MANIFEST).parquet(f"{uri}/manifest").select("file")
    return files.repartitionByRange(max(1, min(files.count(), READERS)), "file").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """op8: all of ``pages`` written below the shared folder and read back."""
    uri = f"{Scratch(spark, 'warc-archives').root}/warc"
    uri = uri if "://" in uri else uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") else f"file://{uri}"
    write(spark.read.parquet(f"{sf_dir}/pages.parquet"), uri)
    return read(spark, uri, with_payload=False).drop("url").withColumnRenamed("id", "page_id")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM d)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> largest THEN largest END AS refers_to
FROM m
"""
