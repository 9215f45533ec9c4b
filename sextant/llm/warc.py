"""WARC archives as chunked record tables.

An archive is a table of chunks: (record, chunk_no, n_chunks, data, running_digest). The data of a record's chunks, in
order, are the bytes of a WARC 1.1 record, and those of all records are a WARC file. The first chunk holds the headers and
the first CHUNK bytes of the payload, so most records are one row. A larger payload goes on in further rows, and no step
holds more of it than a chunk: the digest runs along, and each row carries the digest of the payload up to its end. On
reading, single rows are checked where they lie; only records of several rows are dealt by their number and sorted.

Of records with equal payloads (same SHA-1 and length) of at least min_bytes bytes the one with the largest page_id is
stored as response; the others are revisit records without a payload that refer to it.

Defined results: a null html is an empty payload, a null url an empty target. Repeated rows of the largest page_id are each
a response, of an id of its own; what revisits them names the page and the digest, but no one of their records. A null
page_id is smaller than any other, and stays null; ids are whole numbers of any size (others, as texts, are an error). An empty table gives an
empty archive. Extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sextant.llm.common import bounded_batches, partitions, stored

CHUNK = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "record bigint, chunk_no int, n_chunks int, data binary, running_digest string"
#: Ids go through Python as text: a column of integers with nulls would be one of doubles in pandas.
RECORDS = "page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string, target string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(name: str) -> str:
    h = hashlib.md5(name.encode()).hexdigest()
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}>"


def _text(x: str | None) -> str:
    return "" if pd.isna(x) else x


def _headers(r: object) -> bytes:
    digest = "sha1:" + base32(bytes.fromhex(r.digest))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.bytes}\r\n\r\n".encode()
    own, target = f"{_text(r.page_id)} {r.digest}", "".join(r.url.split())
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if r.revisit else 'response'}", f"WARC-Record-ID: {_urn(own if r.referred else f'{own} {r.record}')}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {digest}"]
    if r.revisit:
        refers = [f"WARC-Refers-To: {_urn(f'{_text(r.keeper)} {r.digest}')}"] if r.single else []
        lines += [f"WARC-Profile: {PROFILE}", *refers, f"Refers-To-Page: {_text(r.keeper)}"]
    lines += [f"Page: {_text(r.page_id)}", f"Payload-Length: {r.bytes}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + (0 if r.revisit else r.bytes)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


def _write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    digest = hashlib.sha1()
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            data = r.data
            if r.chunk_no == 0:
                digest = hashlib.sha1()
            digest.update(data)
            if r.chunk_no == 0:
                data = _headers(r) + data
            if r.chunk_no == r.n_chunks - 1:
                data += b"\r\n\r\n"
            out.append((r.record, r.chunk_no, r.n_chunks, data, base32(digest.digest())))
        yield pd.DataFrame(out, columns=["record", "chunk_no", "n_chunks", "data", "running_digest"])


def archive(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of pages (page_id, url, html)."""
    bounded_batches(pages.sparkSession)
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"))
    digest, size = F.sha1("payload"), F.octet_length("payload").cast("bigint")
    # One small row for each payload that occurs twice, summed up before it is shuffled.
    twice = (
        rows.select("page_id", digest.alias("digest"), size.alias("bytes"))
        .where(F.col("bytes") >= min_bytes)
        .groupBy("digest", "bytes", "page_id")
        .agg(F.count("*").alias("n"))
        .groupBy("digest", "bytes")
        .agg(F.sum("n").alias("n"), F.max("page_id").alias("keeper"), (F.max_by("n", "page_id") == 1).alias("single"))
        .where("n > 1")
        .drop("n")
    )
    known = rows.select("page_id", "url", "payload", digest.alias("digest"), size.alias("bytes")).join(twice, ["digest", "bytes"], "left")
    known = known.withColumn("revisit", F.col("keeper").isNotNull() & ~F.col("keeper").eqNullSafe(F.col("page_id")))
    known = known.withColumn("single", F.coalesce("single", F.lit(False)))
    known = known.withColumn("referred", F.col("single") & F.col("keeper").eqNullSafe(F.col("page_id"))).withColumn("record", F.monotonically_increasing_id())
    n = F.when(F.col("revisit"), 1).otherwise(F.greatest(F.ceil(F.col("bytes") / chunk), F.lit(1))).cast("int")
    cut = known.select("record", "page_id", "url", "digest", "bytes", "keeper", "revisit", "single", "referred", "payload", n.alias("n_chunks"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    data = F.when(F.col("revisit"), F.lit(b"")).otherwise(F.substring(F.col("payload"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    ids = [F.col(c).cast("string").alias(c) for c in ("page_id", "keeper")]
    return cut.select("record", *ids, "url", "digest", "bytes", "revisit", "single", "referred", "n_chunks", "chunk_no", data.alias("data")).mapInPandas(_write, CHUNKS)


class _Reader:
    """One record, chunk by chunk."""

    def __init__(self, first: bytes) -> None:
        head, _, rest = first.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0]!r}")
        self.fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
        http, _, body = rest.partition(b"\r\n\r\n")
        self.revisit = self.fields["WARC-Type"] == "revisit"
        self.left = 0 if self.revisit else int(self.fields["Content-Length"]) - len(http) - 4
        self.read, self.digest = 0, hashlib.sha1()
        self.add(body)

    def add(self, data: bytes) -> None:
        data = data[: self.left - self.read]
        self.read += len(data)
        self.digest.update(data)

    def result(self) -> tuple:
        f, whole = self.fields, base32(self.digest.digest())
        if not self.revisit and (f["WARC-Payload-Digest"] != f"sha1:{whole}" or self.read != int(f["Payload-Length"])):
            raise ValueError(f"damaged record {f['WARC-Record-ID']}")
        return f["Page"] or None, int(f["Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"], f.get("Refers-To-Page") or None, f["WARC-Target-URI"]


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    reader = None
    for pdf in batches:
        out = []
        for no, n, data, running in zip(pdf["chunk_no"], pdf["n_chunks"], pdf["data"], pdf["running_digest"]):
            if no == 0:
                reader = _Reader(data)
            else:
                reader.add(data)
            if not reader.revisit and base32(reader.digest.digest()) != running:
                raise ValueError(f"damaged chunk {no} of {reader.fields['WARC-Record-ID']}")
            if no == n - 1:
                out.append(reader.result())
        yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"]).astype({"payload_bytes": "int64"})


def read_records(chunks: DataFrame) -> DataFrame:
    """Reads and verifies a chunk table: RECORDS, with ids as bigint."""
    bounded_batches(chunks.sparkSession)
    columns = ["record", "chunk_no", "n_chunks", "data", "running_digest"]
    single = chunks.where("n_chunks = 1").select(*columns)
    several = chunks.where("n_chunks > 1").select(*columns).repartition(partitions(chunks.sparkSession), "record").sortWithinPartitions("record", "chunk_no")
    read = single.mapInPandas(_read, RECORDS).unionByName(several.mapInPandas(_read, RECORDS))
    return read.withColumns({c: F.col(c).cast("bigint") for c in ("page_id", "refers_to")})


def export_file(chunks: DataFrame, out: BinaryIO) -> int:
    """Writes a chunk table as one WARC file, a partition at a time; returns its bytes."""
    n = 0
    for r in chunks.orderBy("record", "chunk_no").select("data").toLocalIterator():
        n += out.write(bytes(r.data))
    return n


def round_trip(pages: DataFrame, min_bytes: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Writes the archive of pages into the shared folder and reads it back, a row for each page."""
    return read_records(stored(archive(pages, min_bytes, chunk), "warc")).drop("target")
