"""Deterministic sharded WARC writer and the reader that checks what it wrote.

The order of page_id and digest, cut where the bytes of the payloads add up to a shard, decides which records stand in
which shard; a shard rolls to a new file by compressed size. Tasks write under temporary names that hold a random part. Spark keeps the
manifest rows of one attempt of each task, and only the files that these name get their final names; the manifest is
written last, and a reader takes the files that it names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from bisect import bisect_right

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop, keep, keyed_join, ordered_sums, scratch, table, text_batches

SHARD_BYTES, SHARDS = 32 << 20, 1 << 16
ROLL_BYTES = 64 << 20
LEVEL = 6
DATE = "1970-01-01T00:00:00Z"  #: pages carry no fetch time, and the clock would make files differ between runs
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, seq long, temporary string, name string, records long, bytes long, sha1 string"
RECORD = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, file string"


def store(uri: str):
    """The file system and the path of a URI, for a task in Python."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha1(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. Its headers and digests are made anew from the payload; a revisit has no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}"]
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).digest())}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Roller:
    """Writes records as gzip members, a file after another of a shard, each closed once it has `most` bytes."""

    def __init__(self, path: str, most: int):
        self.fs, self.path = store(path)
        self.most, self.out, self.shard, self.seq = most, None, None, 0

    def add(self, shard: int, raw: bytes):
        """A manifest row where this record closes a file."""
        done = self.close() if shard != self.shard or self.out is None or self.size >= self.most else None
        if shard != self.shard:
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.name = f"_temporary/{shard:06d}-{self.seq:06d}-{uuid.uuid4().hex}"
            self.fs.create_dir(f"{self.path}/_temporary", recursive=True)
            self.out = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.size, self.records, self.sha1 = 0, 0, hashlib.sha1()
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        member = packer.compress(raw) + packer.flush()
        self.out.write(member)
        self.sha1.update(member)
        self.size += len(member)
        self.records += 1
        return done

    def close(self):
        if self.out is None:
            return None
        self.out.close()
        self.out = None
        row = (self.shard, self.seq, self.name, f"pages-{self.shard:06d}-{self.seq:06d}.warc.gz", self.records, self.size, self.sha1.hexdigest())
        self.seq += 1
        return row


def place(page_id: int | None, digest: str) -> tuple:
    """The key of the order of records: null page_ids first."""
    return page_id is not None, page_id or 0, digest


def batch_of(rows: list, ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.strip().split(" ") for f in ddl.split(",")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])


def write_warc(pages: DataFrame, path: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, least: int = 0) -> DataFrame:
    """Writes (page_id, url, html) to `path` and returns the manifest. A payload is the html in UTF-8, null empty.

    Of records with equal payloads of `least` bytes or more, that with the least page_id is a response and the others
    are revisits that name it; of rows that share that page_id too, one is. A null page_id is never named: payloads that
    only such rows have are all responses.
    """
    spark = pages.sparkSession
    text_batches(spark)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    thin = keep(pages.select("page_id", "digest", F.octet_length("payload").cast("long").alias("bytes")), "payloads", wide=True)
    firsts = thin.where(F.col("bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    firsts = keep(firsts.select("digest", F.col("first").alias("refers_to")), "firsts")
    refs = keyed_join(thin, firsts, ["digest"]).select("page_id", "digest", "refers_to").distinct()

    # a shard begins where the bytes of all records before it, in order of page_id and digest, add up to it
    sized = thin.withColumn("bytes", F.col("bytes") + 512)
    size = max(shard_bytes, -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // SHARDS))
    placed = ordered_sums(sized, [], ["page_id", "digest"], "bytes", "order").withColumn("run", F.floor(F.col("before") / size))
    cuts = sorted(place(*r["first"]) for r in placed.groupBy("run").agg(F.min(F.struct("page_id", "digest")).alias("first")).collect())  # SHARDS + 1 rows at most

    @F.pandas_udf("long")
    def shard_of(page: pd.Series, digest: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, place(None if p is None else int(p), d)) - 1 for p, d in zip(page, digest, strict=True)], dtype="int64")

    rows = pages.withColumn("refers_to", F.lit(None).cast("long")).withColumn("kind", F.lit(1)).unionByName(refs.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    rows = rows.withColumn("shard", shard_of(F.col("page_id").cast("string"), "digest"))
    # a reference stands just before the pages that it is about: no join has to carry payloads
    rows = rows.repartitionById(max(len(cuts), 1), F.col("shard").cast("int")).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")

    def write(batches):
        roller, about, named = Roller(path, roll_bytes), None, False
        for batch in batches:
            done = []
            for page, url, payload, digest, to, kind, shard in zip(*[batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "kind", "shard")], strict=True):
                page, digest = page.as_py(), digest.as_py()
                if kind.as_py() == 0:
                    about, named, target = (page, digest), page == to.as_py(), to.as_py()
                    continue
                revisit = about == (page, digest) and not named
                if about == (page, digest):
                    named = False  # the first row of the least page_id is the response
                raw = record(page, url.as_py(), payload.as_py(), base32(bytes.fromhex(digest)), target if revisit else None, revisit)
                done.append(roller.add(shard.as_py(), raw))
            yield batch_of([d for d in done if d], MANIFEST)
        yield batch_of([d for d in [roller.close()] if d], MANIFEST)

    written = keep(rows.mapInArrow(write, MANIFEST), "manifest", wide=True)

    def commit(batches):
        fs, at = store(path)
        for batch in batches:
            for temporary, name in zip(batch.column("temporary").to_pylist(), batch.column("name").to_pylist(), strict=True):
                done = fs.get_file_info(f"{at}/{name}").is_file and not fs.get_file_info(f"{at}/{temporary}").is_file
                if not done:  # a repeated task finds it moved already
                    fs.move(f"{at}/{temporary}", f"{at}/{name}")
            yield batch

    written.repartition("name").mapInArrow(commit, MANIFEST).write.mode("overwrite").parquet(f"{path}/_manifest")
    drop(spark, f"{path}/_temporary")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def records(stream: io.BufferedReader):
    """(headers, block) of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().strip()):
            k, _, v = line.decode().partition(":")
            head[k] = v.strip()
        block = stream.read(int(head["Content-Length"]))
        yield head, block


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """A row per record of the files in the manifest. Payload and block digests are computed again and must agree."""

    def read(batches):
        fs, at = store(path)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with fs.open_input_stream(f"{at}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as plain:
                    for head, block in records(io.BufferedReader(plain, 1 << 20)):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                        if base32(hashlib.sha1(block).digest()) != head["WARC-Block-Digest"].removeprefix("sha1:") or kind == "response" and (base32(hashlib.sha1(payload).digest()) != digest or len(payload) != size):
                            raise ValueError(f"{name}: a digest does not agree")
                        number = lambda k, head=head: int(head[k]) if k in head else None
                        rows.append((number("WARC-Page-ID"), head["WARC-Target-URI"], kind, size, digest, number("WARC-Refers-To-Page-ID"), name))
                        if len(rows) >= 5000:
                            yield batch_of(rows, RECORD)
                            rows = []
                yield batch_of(rows, RECORD)

    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest").repartition("name").mapInArrow(read, RECORD)


def op10_sharded_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record, read back from the archives.

    A null html is an empty payload; empty payloads are compared like any other; a null url becomes urn:page:ID and a
    null page_id stays null; repeated rows are revisits of the first; an empty table gives no rows.
    """
    path = scratch(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: base32 of SHA-1: 160 bits in groups of five
OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages
), f AS (
  SELECT *, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS k, min(page_id) OVER (PARTITION BY h) AS first FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(40), lambda i: substr('0000000100100011010001010110011110001001101010111100110111101111', 4 * (instr('0123456789abcdef', substr(h, i + 1, 1)) - 1) + 1, 4)), '') AS bits FROM f
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: CAST(substr(bits, 5 * i + j + 1, 1) AS INTEGER) * CAST(pow(2, 4 - j) AS INTEGER)))::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN k = 1 OR first IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k = 1 OR first IS NULL THEN NULL ELSE first END AS refers_to
FROM b
"""
