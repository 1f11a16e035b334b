"""Zstandard WARC archives.

An archive opens with a skippable frame that holds the dictionary, then has one
frame per record. Archives are binary values of a Parquet table in the shared
folder (one row per archive), so that they can be written and read wherever
Spark can, and a lost executor loses none; ``export`` writes them as files.
"""

from __future__ import annotations

import hashlib
import os
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hopweave.llm._bytes import batch_rows, trimmed
from hopweave.storage import discard, materialize

# Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_BYTES = 8 << 20
#: Pages that the dictionary is trained on, at most, and their leading bytes each.
DICTIONARY_PAGES, DICTIONARY_PAGE_BYTES, DICTIONARY_BYTES = 256, 16_384, 32_768
MIN_REVISIT = 100


class WarcError(ValueError):
    pass


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page {page_id}')}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None) -> bytes:
    """One WARC record; with refers_to a revisit, whose block holds no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id)), ("WARC-Date", "2025-01-01T00:00:00Z")]
    if url:
        head.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    head += [("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Payload-Length", str(len(payload))), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if refers_to is not None:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block; WarcError where the version, a header or a length is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or lines[0] != VERSION:
        raise WarcError("not a WARC/1.1 record")
    headers = {}
    for line in lines[1:]:
        k, colon, v = line.decode("utf-8").partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", k) or k in headers:
            raise WarcError(f"bad header line {line[:80]!r}")
        headers[k] = v.strip()
    for k in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"):
        if k not in headers:
            raise WarcError(f"no {k}")
    if not re.fullmatch(r"\d+", headers["Content-Length"]) or len(rest) != int(headers["Content-Length"]) + 4:
        raise WarcError("Content-Length does not match the record")
    if rest[-4:] != b"\r\n\r\n":
        raise WarcError("no end of record")
    return headers, rest[:-4]


def frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame at ``at`` ends, from its block headers."""
    import zstandard

    if bytes(data[at : at + 4]) != FRAME:
        raise WarcError(f"no frame at byte {at}")
    checksum = data[at + 4] & 4
    at += zstandard.frame_header_size(bytes(data[at : at + 18]))
    last = 0
    while not last:
        if at + 3 > len(data):
            raise WarcError("truncated frame")
        word = int.from_bytes(data[at : at + 3], "little")
        last, kind, size = word & 1, word >> 1 & 3, word >> 3
        if kind == 3:
            raise WarcError("reserved block type")
        at += 3 + (1 if kind == 1 else size)
    at += 4 if checksum else 0
    if at > len(data):
        raise WarcError("truncated frame")
    return at


def read_archive(content: bytes):
    """Each record's (headers, block), one frame decoded at a time."""
    import zstandard

    view, at, options = memoryview(content), 0, {}
    if len(view) >= 8 and struct.unpack_from("<I", view)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise WarcError("truncated dictionary frame")
        dictionary = bytes(view[8 : 8 + size])
        if dictionary[:4] == FRAME:  # the dictionary itself may be compressed
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary, max_output_size=1 << 26)
        options, at = {"dict_data": zstandard.ZstdCompressionDict(dictionary)}, 8 + size
    decoder = zstandard.ZstdDecompressor(**options)
    while at < len(view):
        end = frame_end(view, at)
        try:  # a frame need not name its content's size
            block = decoder.decompressobj().decompress(view[at:end])
        except zstandard.ZstdError as e:
            raise WarcError(f"damaged frame: {e}") from None
        yield parse_record(block)
        at = end


def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary from a bounded sample: the pages with the smallest hashed ids. Empty where there are too few."""
    import zstandard

    rows = pages.where("html is not null").select(F.xxhash64("page_id").alias("h"), F.substring(F.col("html"), 1, DICTIONARY_PAGE_BYTES).alias("t")).orderBy("h", "t").limit(DICTIONARY_PAGES).collect()
    samples = [r["t"].encode()[:DICTIONARY_PAGE_BYTES] for r in rows]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [s for s in samples if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def write_archives(pages: DataFrame) -> DataFrame:
    """A stored table (archive string, content binary) of pages(page_id, url, html).

    Of records with equal payloads (html in UTF-8, null: empty) of MIN_REVISIT bytes or more, those with the smallest
    page_id are responses, the others revisits that refer to it; smaller ones are all responses. Rows that repeat
    the smallest page_id are all responses. A null page_id is never referred to. Other columns are ignored.
    """
    batch_rows(pages.sparkSession, 1000)
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    keyed = pages.select("page_id", digest.alias("digest")).where(F.octet_length("html") >= MIN_REVISIT)
    first = materialize(keyed.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("k")).where("k > 1 and first is not null").select("digest", "first"), "warc-first")
    dictionary = pages.sparkSession.sparkContext.broadcast(train_dictionary(pages))  # DICTIONARY_BYTES at most

    def run(batches):
        import zstandard

        d = dictionary.value
        writer = zstandard.ZstdCompressor(level=3, write_checksum=True, **({"dict_data": zstandard.ZstdCompressionDict(d)} if d else {}))
        lead = struct.pack("<II", SKIPPABLE, len(d)) + d if d else b""
        parts, size = [lead], 0
        for batch in batches:
            for page, url, html, sha, ref in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "digest", "first"))):
                frame = writer.compress(record(page, url, html.encode(), sha, ref if ref != page else None))
                parts.append(frame)
                size += len(frame)
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.zst"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])
                    parts, size = [lead], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([f"{uuid.uuid4().hex}.warc.zst"]), pa.array([b"".join(parts)], pa.binary())], ["archive", "content"])

    rows = pages.withColumn("digest", digest).join(first, "digest", "left").select("page_id", "url", "html", "digest", "first")
    out = materialize(rows.mapInArrow(trimmed(run), "archive string, content binary"), "warc-archives")
    discard(first)
    return out


def read_archives(archives: DataFrame) -> DataFrame:
    """(page_id, target_uri, payload_bytes, payload_digest, record_type, refers_to, payload) of every record.

    WarcError where a frame, header, length or payload digest is wrong.
    """

    def run(batches):
        names = ["page_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch["content"]:
                out: list[list] = [[] for _ in names]
                held = 0

                def flush(out=out):
                    got = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], names)
                    for x in out:
                        x.clear()
                    return got

                for headers, block in read_archive(content.as_buffer().to_pybytes()):
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, length, sha = headers["WARC-Type"], int(headers["X-Payload-Length"]), headers["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != sha):
                        raise WarcError(f"payload of {headers['WARC-Record-ID']} does not match its headers")
                    if kind == "revisit" and payload:
                        raise WarcError("a revisit holds a payload")
                    ref = headers.get("X-Refers-To-Page-ID")
                    page = headers["X-Page-ID"]
                    for x, v in zip(out, (int(page) if page else None, headers.get("WARC-Target-URI"), length, sha, kind, int(ref) if ref else None, payload if kind == "response" else None)):
                        x.append(v)
                    held += len(payload)
                    if held > 1 << 23:
                        yield flush()
                        held = 0
                if out[0]:
                    yield flush()

    return archives.select("content").mapInArrow(trimmed(run), "page_id long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def export(archives: DataFrame, folder: str) -> None:
    """Write the archives as files into a folder that every executor has mounted."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch["archive"].to_pylist(), batch["content"]):
                with open(os.path.join(folder, f".{name}"), "wb") as f:
                    f.write(content.as_buffer())
                os.replace(os.path.join(folder, f".{name}"), os.path.join(folder, name))
            yield batch.select(["archive"])

    archives.mapInArrow(trimmed(run), "archive string").count()


def op4_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
     q AS (SELECT page_id, n, sha256(h) AS d, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND first <> page_id THEN first END AS refers_to
FROM q
"""
