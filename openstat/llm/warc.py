"""WARC archives: an index first, then coalesced byte-range reads.

Each task writes its records as gzip members into one file of its own and returns
an index row per record: file, offset, length, URL, digest. The index is a Parquet
table, so it names only the files of tasks that Spark committed; a file left by a
lost or repeated task is never read. Readers pick records from the index, sort them
by place, join near neighbours into one byte range and read each range once.

Null html is an empty payload. URLs and ids, null ones too, are read back unchanged; a revisit
names the length of the payload that it stands for. Of equal payloads of at
least `least` bytes the smallest page id is the response and the others revisit it;
null ids and repeated ids follow the order (id, URL), nulls last;
rows that repeat id, URL and payload are all responses. Empty input gives no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from openstat.session import shared_dir, store

INDEX_SCHEMA = (
    "page_id string, record_type string, url string, payload_digest string, "
    "file string, offset long, length long"
)
WRITTEN = pa.schema(
    [(n, pa.int64() if n in ("offset", "length") else pa.string())
     for n in ("page_id", "record_type", "url", "payload_digest", "file", "offset", "length")]
)
READ_SCHEMA = (
    "page_id string, record_type string, url string, payload_digest string, refers_to string, "
    "payload_bytes long, payload binary"
)
READ = pa.schema(
    [(n, pa.string()) for n in ("page_id", "record_type", "url", "payload_digest", "refers_to")]
    + [("payload_bytes", pa.int64()), ("payload", pa.binary())]
)
#: Bytes between two records that are read along rather than skipped, and the most in one read.
GAP, SPAN = 64 << 10, 8 << 20
#: An archive is closed when it has reached so many bytes.
ARCHIVE = 64 << 20
CRLF = b"\r\n"


def named(page_id: str | None) -> str:
    return "<urn:page>" if page_id is None else f"<urn:page:{quote(page_id)}>"


def page_of(name: str | None) -> str | None:
    return unquote(name[len("<urn:page:") : -1]) if name and name != "<urn:page>" else None


def record(kind: str, row: dict) -> bytes:
    """One WARC/1.1 record as a gzip member."""
    url = row["url"] or ""
    target = quote(url, safe="%!#$&'()*+,/:;=?@[]~<>{}|\\^`\"")
    head = [
        ("WARC-Type", kind), ("WARC-Record-ID", named(row["page_id"])),
        ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha256:{row['payload_digest']}"),
        ("Content-Type", "text/html; charset=utf-8"),
    ]
    if target != row["url"]:  # white space, other scripts or null: the URL itself goes along
        head.append(("X-Target-URL", json.dumps(row["url"])))
    body = row["payload"]
    if kind == "revisit":
        head += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", named(row["refers_to"])), ("X-Payload-Length", str(row["payload_bytes"])),
        ]
        body = b""
    head.append(("Content-Length", str(len(body))))
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in head)]
    return gzip.compress(CRLF.join([*lines, b"", body]) + CRLF * 2, 6, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    raw = gzip.decompress(member)
    end = raw.index(CRLF * 2)
    head = dict(line.split(": ", 1) for line in raw[:end].decode().split("\r\n")[1:])
    start = end + 4
    return head, raw[start : start + int(head["Content-Length"])]


def _writer(folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store_, base = fs.FileSystem.from_uri(folder)
        out, path, at, index = None, "", 0, []
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path, at, index = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, []
                    out = store_.open_output_stream(path, compression=None)
                made = record(row["record_type"], row)
                out.write(made)
                index.append(
                    {k: row[k] for k in ("page_id", "record_type", "url", "payload_digest")}
                    | {"file": path, "offset": at, "length": len(made)}
                )
                at += len(made)
                if at >= ARCHIVE:  # rows of an archive are told when it is whole
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pylist(index, WRITTEN)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist(index, WRITTEN)

    return write


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark itself gives it, so that all tasks and readers mean the same place."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"file://{full.removeprefix('file:')}" if full.startswith("file:/") and not full.startswith("file://") else full


def write_archives(pages: DataFrame, least: int = 100, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write one record per row; returns the stored index (INDEX_SCHEMA)."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")
    ).withColumn("payload_digest", F.sha2("payload", 256))
    place = F.struct(F.col("page_id").isNull(), "page_id", F.coalesce("url", F.lit("")))
    first = (
        rows.filter(F.octet_length("payload") >= least).groupBy("payload_digest")
        .agg(F.min(place).alias("first"))
    )
    revisit = F.col("first").isNotNull() & (place != F.col("first"))
    records = rows.join(first, "payload_digest", "left").select(
        F.col("page_id").cast("string").alias("page_id"), "url", "payload_digest",
        F.col("first.page_id").cast("string").alias("refers_to"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(~revisit, F.col("payload")).otherwise(F.lit(b"")).alias("payload"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
    )
    folder = qualified(spark, f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")
    where, base = fs.FileSystem.from_uri(folder)
    where.create_dir(base)
    return store(records.mapInArrow(_writer(folder), INDEX_SCHEMA).withColumn("store", F.lit(folder)))


def ranges(offsets: np.ndarray, lengths: np.ndarray, gap: int = GAP, span: int = SPAN) -> list[tuple[int, int]]:
    """First and past-last record of each read, for records sorted by offset."""
    out, start = [], 0
    for i in range(1, len(offsets) + 1):
        if i == len(offsets) or offsets[i] - (offsets[i - 1] + lengths[i - 1]) > gap or (
            offsets[i] + lengths[i] - offsets[start] > span
        ):
            out.append((start, i))
            start = i
    return out


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened: tuple[str, object] = ("", None)
    for batch in batches:
        rows = batch.to_pylist()
        a = 0
        while a < len(rows):
            b = a
            while b < len(rows) and rows[b]["file"] == rows[a]["file"]:
                b += 1
            part = rows[a:b]
            if opened[0] != part[0]["file"]:
                if opened[1] is not None:
                    opened[1].close()
                where, _ = fs.FileSystem.from_uri(part[0]["store"])
                opened = (part[0]["file"], where.open_input_file(part[0]["file"]))
            offsets = np.array([r["offset"] for r in part])
            lengths = np.array([r["length"] for r in part])
            for i, j in ranges(offsets, lengths):
                opened[1].seek(int(offsets[i]))
                block = opened[1].read(int(offsets[j - 1] + lengths[j - 1] - offsets[i]))
                found = []
                for r in part[i:j]:
                    at = r["offset"] - int(offsets[i])
                    head, payload = parse_record(block[at : at + r["length"]])
                    found.append({
                        "page_id": page_of(head["WARC-Record-ID"]),
                        "record_type": head["WARC-Type"],
                        "url": json.loads(head["X-Target-URL"]) if "X-Target-URL" in head else head["WARC-Target-URI"],
                        "payload_digest": hashlib.sha256(payload).hexdigest() if head["WARC-Type"] == "response" else head["WARC-Payload-Digest"].removeprefix("sha256:"),
                        "refers_to": page_of(head.get("WARC-Refers-To")),
                        "payload_bytes": int(head.get("X-Payload-Length", len(payload))), "payload": payload,
                    })
                yield pa.RecordBatch.from_pylist(found, READ)
            a = b
    if opened[1] is not None:
        opened[1].close()


def read_records(index: DataFrame, where: str = "true") -> DataFrame:
    """The records of `index` that meet `where`, read back from the archives."""
    return (
        index.filter(where).repartition("file").sortWithinPartitions("file", "offset")
        .mapInArrow(_read, READ_SCHEMA)
    )
