"""WARC archives: a deterministic sharded writer and a reader.

Records are sorted by id and payload digest and dealt to shards by ranges of these.
The bounds are every ``SAMPLE``-th key of those whose hashes are least, ``SAMPLE`` for
each shard, a function of the data alone, so the same rows give the same files on any
cluster; the driver meets one bound for each shard (28 bytes for ``SHARD`` bytes of
payload).  An id that many records share is split by their digests.  Of records with equal payloads of
``least`` bytes at least, the one with the largest id is the response and the
others are revisits that refer to it; the digests meet in an aggregation that
combines before its shuffle, and only the few facts about revisits join the
payloads' one shuffle.  A task writes its shards one by one, each record a gzip
member of its own, and begins a new file when the compressed size reaches the
limit.  A file is written under a temporary name and renamed when complete; a
manifest of the files, committed last, is what readers go by, so a lost task's
leftovers are never read and a repeated task writes the same bytes again.  The
temporary folder goes when the manifest is there.

Null payload counts as empty.  A null id counts as the smallest and reads back as
null.  Rows that repeat an id and a payload with the largest id are all responses.
An archive path must be one that ``pyarrow.fs`` can open.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.report import numbered

from .common import NULL_ID, cleaned, id_key, lean, new_path, partitions, sliced, table

SAMPLE = 32
#: Bytes of payload meant for a shard, and compressed bytes at which a file ends.
SHARD, FILE = 32 << 20, 64 << 20
DATE = "1970-01-01T00:00:00Z"
MANIFEST = "file string, records long, bytes long, sha256 string, first long, last long"
RECORDS = "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _urn(key: int) -> str:
    return "<urn:page:null>" if key == NULL_ID else f"<urn:page:{key}>"


def _id(urn: str) -> int | None:
    value = urn.strip("<>").rpartition(":")[2]
    return None if value == "null" else int(value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)  # no time or name in the gzip header
    return packer.compress(head.encode() + block + b"\r\n\r\n") + packer.flush()


def page_record(key: int, url: str | None, payload: bytes | None, size: int, sha1: str, refers: int | None) -> bytes:
    headers = [("WARC-Record-ID", _urn(key)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    headers.append(("WARC-Payload-Digest", f"sha1:{sha1}"))
    if refers is not None:
        headers += [("WARC-Refers-To", _urn(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Payload-Length", str(size))]
        return record("revisit", headers, b"")
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + payload
    headers += [("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Type", "application/http;msgtype=response")]
    return record("response", headers, block)


class _File:
    """A file under a temporary name until it is closed."""

    def __init__(self, root: str, name: str) -> None:
        self.fs, base = fs.FileSystem.from_uri(root)
        self.name, self.target, self.temporary = name, f"{base}/{name}", f"{base}/_temporary/{uuid.uuid4().hex}"
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.records, self.size, self.sha, self.first, self.last = 0, 0, hashlib.sha256(), None, None
        self.write(record("warcinfo", [("WARC-Record-ID", f"<urn:file:{name}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)
        self.sha.update(data)

    def close(self) -> tuple:
        self.out.close()
        self.fs.move(self.temporary, self.target)
        return self.name, self.records, self.size, self.sha.hexdigest(), self.first, self.last


def _key(id_: str, sha: str) -> Column:
    """Bytes whose order is that of id and digest."""
    return F.concat(F.unhex(F.lpad(F.hex(F.col(id_).bitwiseXOR(F.lit(NULL_ID))), 16, "0")), F.col(sha))


def write(pages: DataFrame, root: str, page_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, shard_bytes: int = SHARD, file_bytes: int = FILE) -> DataFrame:
    """Write the archive under ``root`` and return its manifest."""
    spark = pages.sparkSession
    rows = pages.select(id_key(page_id).alias("id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha": F.unhex(F.sha1("payload"))})
    marks = table(rows.select("id", "size", "sha"), "digests")
    heads = marks.where(F.col("size") >= least).groupBy("sha").agg(F.max("id").alias("head"), F.count("*").alias("n")).where("n > 1").drop("n")
    facts = marks.where(F.col("size") >= least).join(heads, "sha").where("id < head").groupBy("id", "sha").agg(F.max("head").alias("head"))
    total = marks.agg(F.sum("size")).first()[0] or 0
    shards = max(1, -(-total // shard_bytes))
    keys = marks.select(_key("id", "sha").alias("key"))
    n = marks.count()
    if shards > 1:
        share = (2**64 - 1) * min(n, SAMPLE * shards) // n - 2**63
        drawn = table(keys.where(F.xxhash64("key") <= share), "sample")
        step = max(1, drawn.count() // shards)
        bounds = [bytes(r[0]) for r in numbered(drawn, "key").where(F.col("number") % step == 0).orderBy("number").select("key").collect()]
    else:
        bounds = []
    edges = np.unique(np.array(bounds, "S28"))

    @F.pandas_udf("int")
    def shard(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, np.array(keys.tolist(), "S28"), side="right").astype(np.int32))

    void = F.lit(None)
    both = rows.select("id", "sha", F.lit(1).alias("kind"), "url", "payload", "size", void.cast("long").alias("head")).unionByName(
        facts.select("id", "sha", F.lit(0).alias("kind"), void.cast("string").alias("url"), void.cast("binary").alias("payload"), F.lit(0).cast("long").alias("size"), "head")
    )
    dealt = both.withColumn("shard", shard(_key("id", "sha"))).repartitionById(len(edges) + 1, F.col("shard")).sortWithinPartitions("shard", "id", "sha", "kind", "url")
    schema = pa.schema([(n, pa.string() if k == "string" else pa.int64()) for n, k in (x.split() for x in MANIFEST.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, file, here, part, fact = [], None, None, 0, None
        for batch in sliced(batches, "payload"):
            for key, sha, kind, link, body, size, head, shard in zip(*(batch.column(n).to_pylist() for n in range(8)), strict=True):
                if not kind:
                    fact = key, sha, head
                    continue
                if file and (shard != here or file.size >= file_bytes):
                    done.append(file.close())
                    file = None
                if file is None:
                    part = part + 1 if shard == here else 0
                    here, file = shard, _File(root, f"part-{shard:05d}-{part:05d}.warc.gz")
                refers = fact[2] if fact and fact[:2] == (key, sha) else None
                file.write(page_record(key, link, body, size, base64.b32encode(sha).decode(), refers))
                file.records += 1
                file.first, file.last = key if file.first is None else file.first, key
        if file:
            done.append(file.close())
        if done:
            yield pa.record_batch([list(c) for c in zip(*done, strict=True)], schema=schema)

    with cleaned(spark):
        dealt.mapInArrow(lean(run), MANIFEST).write.parquet(f"{root}/_manifest")
    system, base = fs.FileSystem.from_uri(root)
    if system.get_file_info(f"{base}/_temporary").type != fs.FileType.NotFound:
        system.delete_dir(f"{base}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{root}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an open file, a gzip member at a time."""
    rest = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            rest = rest or stream.read(1 << 20)
            if not rest:
                if parts:
                    raise ValueError("archive ends inside a record")
                return
            parts.append(unpack.decompress(rest))
            rest = unpack.unused_data
        head, _, tail = b"".join(parts).partition(b"\r\n\r\n")
        headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield headers, tail[: int(headers["Content-Length"])]


def read(spark: SparkSession, root: str, with_payload: bool = True) -> DataFrame:
    """The records of the files that the manifest lists; digests are computed anew and compared."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (x.split() for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with system.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for head, block in records(stream):
                        if head["WARC-Type"] == "warcinfo":
                            continue
                        sha1 = head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if head["WARC-Type"] == "revisit":
                            body, size, refers = None, int(head["X-Payload-Length"]), _id(head["WARC-Refers-To"])
                        else:
                            body, refers = block.partition(b"\r\n\r\n")[2], None
                            size, found = len(body), digest(body)
                            if found != sha1:
                                raise ValueError(f"digest of {head['WARC-Record-ID']} is {found}, not {sha1}")
                        rows.append((_id(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), head["WARC-Type"], body if with_payload else None, size, sha1, refers))
                        held += len(block) if with_payload else 100
                        if held >= 8 << 20:
                            yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.record_batch([list(c) for c in zip(*rows, strict=True)], schema=schema)

    files = spark.read.schema(MANIFEST).parquet(f"{root}/_manifest").select("file")
    return files.repartition(partitions(spark)).mapInArrow(lean(run), RECORDS)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each record of an archive of ``pages``."""
    root = new_path(pages.sparkSession, "archive")
    write(pages, root, least=least)
    return read(pages.sparkSession, root, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
