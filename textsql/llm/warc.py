"""Operator 4: deterministic sharded WARC writer and reader.

Records are range-sorted by page_id; each task rolls to a new file once the compressed size reaches
``ROLL_BYTES``, regenerates headers and digests from the payload, writes under a temporary name of
its own and renames to a name that depends on the shard only, so a repeated task replaces its own
files by equal ones. The files' manifest is written last; the reader opens only files it lists.
Of equal payloads of at least ``MIN_REVISIT`` bytes the smallest page_id is the response.

Which payloads repeat is found on narrow rows (page_id, digest, size). Its outcome, a mark for each page and digest
that repeat, is sorted in front of the page's own records, so payloads are shuffled once, straight into the
writer. The number of shards follows the payload bytes.

Defined cases: null html is an empty payload; null url an empty target; a null page_id sorts first
and is written with an empty id; rows repeating a page_id are all written: those of other payloads as records of
their own, those of the same payload (``MIN_REVISIT`` bytes or more) as one response and revisits of it; an
empty table gives an archive without records; extra columns are never read. A folder without a scheme is taken
on the cluster's default file system. Rows that repeat both page_id and payload are sorted in one task.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, salted_lookup

MIN_REVISIT, ROLL_BYTES, SHARD_BYTES = 100, 64 * 1024 * 1024, 256 * 1024 * 1024
DATE = "2024-01-01T00:00:00Z"  # fixed: equal inputs give equal bytes
MANIFEST = "file string, records long, bytes long, sha256 string"
ORDERED = ["page_id", "digest", "is_record", "url", "payload", "owner"]
_EOL = b"\r\n"


def keyed_pages(pages: DataFrame) -> DataFrame:
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload")).withColumn(
        "digest", F.unhex(F.sha2("payload", 256)))


def repeat_marks(narrow: DataFrame) -> DataFrame:
    """(page_id, digest, owner) of every page and digest whose payload is found more than once."""
    owner = materialise(narrow.where(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(
        F.min("page_id").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n"), "owners")
    return salted_lookup(narrow.select("page_id", "digest"), owner, "digest", "page_id", "inner").distinct()


def record(page_id, url: str, payload: bytes, kind: str, refers_to) -> bytes:
    """One gzip member: header block, blank line, body, two line ends. Header values carry no line breaks."""
    body = payload if kind == "response" else b""
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), b"WARC-Date: " + DATE.encode(),
            b"WARC-Record-ID: <urn:page:" + (b"" if page_id is None else str(page_id).encode()) + b">",
            b"WARC-Target-URI: " + json.dumps(url)[1:-1].encode(),
            b"WARC-Payload-Digest: sha256:" + hashlib.sha256(payload).hexdigest().encode(),
            b"X-Payload-Length: " + str(len(payload)).encode(),
            b"Content-Type: text/html; charset=utf-8", b"Content-Length: " + str(len(body)).encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:" + str(refers_to).encode() + b">",
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return gzip.compress(_EOL.join(head) + _EOL * 2 + body + _EOL * 2, mtime=0)


def _filesystem(path: str):
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path)


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        state = {"out": None, "n": 0, "size": 0, "sha": None, "file": 0}
        done, mark, owner, given = [], None, None, False

        def close():
            state["out"].close()
            name = f"part-{shard:06d}-{state['file']:04d}.warc.gz"
            fs.move(f"{base}/{name}.{attempt}.tmp", f"{base}/{name}")
            done.append((name, state["n"], state["size"], state["sha"].hexdigest()))
            state.update(out=None, file=state["file"] + 1)

        for pdf in batches:
            for page_id, digest, is_record, url, payload, own in zip(*(pdf[c] for c in ORDERED)):
                if not is_record:  # sorted in front of the records it speaks of
                    mark, owner, given = (page_id, bytes(digest)), own, False
                    continue
                again = mark == (page_id, bytes(digest)) and (owner != page_id or given)
                given = True
                data = record(page_id, url, payload, "revisit" if again else "response", owner if again else None)
                if state["out"] is None:
                    name = f"part-{shard:06d}-{state['file']:04d}.warc.gz"
                    state.update(out=fs.open_output_stream(f"{base}/{name}.{attempt}.tmp", compression=None),
                                 n=0, size=0, sha=hashlib.sha256())
                state["out"].write(data)
                state["sha"].update(data)
                state["n"] += 1
                state["size"] += len(data)
                if state["size"] >= roll_bytes:
                    close()
        if state["out"] is not None:
            close()
        yield pd.DataFrame(done, columns=["file", "records", "bytes", "sha256"])

    return write


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shards: int | None = None) -> DataFrame:
    """Write the archive and commit its manifest (``folder``/manifest); returns the manifest."""
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    rows = keyed_pages(pages)
    narrow = materialise(rows.select("page_id", "digest", F.length("payload").alias("size")), "page_digests")
    total = narrow.agg(F.sum(F.col("size").cast("long"))).first()[0] or 0
    n = shards or max(spark.sparkContext.defaultParallelism, -(-total // SHARD_BYTES))
    none = lambda kind: F.lit(None).cast(kind)
    marks = repeat_marks(narrow).select("page_id", "digest", F.lit(0).alias("is_record"), none("string").alias("url"),
                                        none("binary").alias("payload"), "owner")
    records = rows.select("page_id", "digest", F.lit(1).alias("is_record"), "url", "payload", none("long").alias("owner"))
    ordered = records.unionByName(marks).repartitionByRange(n, "page_id", "digest").sortWithinPartitions(
        "page_id", "digest", "is_record", "url")
    text = {c: F.col(c).cast("string") for c in ("page_id", "owner")}  # pandas has no null integer without loss
    ordered.withColumns(text).select(*ORDERED).mapInPandas(_writer(f"{folder}/data", roll_bytes), MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder with its scheme: one without is on the cluster's default file system, never on a worker's disk."""
    if "://" in folder or folder.startswith("file:"):
        return folder
    return spark.conf.get("spark.hadoop.fs.defaultFS", "file://").rstrip("/") + folder


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, body) of each record of a decompressed archive stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"not a record start: {line[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            headers[name] = value
        body = stream.read(int(headers["Content-Length"]))
        if stream.read(4) != _EOL * 2:
            raise ValueError("record without its end")
        yield headers, body


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """Records of the files that the manifest lists; a response's digest is checked on its body."""
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = _filesystem(f"{folder}/data")
        number = lambda urn: int(urn[len("<urn:page:"):-1]) if urn and len(urn) > len("<urn:page:>") else None
        cols = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        for pdf in batches:
            for name in pdf["file"]:
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as raw, \
                        io.BufferedReader(gzip.GzipFile(fileobj=raw)) as stream:
                    for h, body in read_records(stream):
                        digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
                        if h["WARC-Type"] == "response" and hashlib.sha256(body).hexdigest() != digest:
                            raise ValueError(f"digest mismatch in {name}")
                        rows.append((number(h["WARC-Record-ID"]), json.loads(f'"{h["WARC-Target-URI"]}"'),
                                     int(h["X-Payload-Length"]), digest, h["WARC-Type"], number(h.get("WARC-Refers-To")),
                                     body if h["WARC-Type"] == "response" else None))
                        if len(rows) >= 1000:
                            yield pd.DataFrame(rows, columns=cols).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows = []
                yield pd.DataFrame(rows, columns=cols).astype({"page_id": "Int64", "refers_to": "Int64"})

    folder = qualified(spark, folder)
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    files = files.repartition(max(spark.sparkContext.defaultParallelism, 1), "file")
    return files.select("file").mapInPandas(
        read, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long, payload binary")


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha256(b) AS h FROM p),
o AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS own FROM d)
SELECT page_id, n AS payload_bytes, h AS payload_digest, CASE WHEN own = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN own = page_id THEN NULL ELSE own END AS refers_to FROM o
"""
