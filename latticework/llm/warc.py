"""WARC archives of one Zstandard frame a record, with a dictionary in a leading
skippable frame: writer, and a reader that loads that dictionary, decodes frame
by frame, and validates headers and lengths."""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import join_keyed, materialize, new_folder, shuffle_width
from latticework.llm.files import get, put

#: The skippable frame that holds a dictionary, a dictionary's
#: own magic number, and that of a Zstandard frame.
DICT_FRAME, DICT_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
#: Bytes of payload in an archive, about; payloads and bytes that train its dictionary; its size; its level.
ARCHIVE_BYTES, TRAIN_PAYLOADS, TRAIN_BYTES, DICT_BYTES, LEVEL = 8 << 20, 400, 1 << 20, 16 << 10, 3
#: Bytes that the reader feeds at once, so that little lies beyond a frame's end.
FEED = 16 << 10
#: Payloads shorter than this are never stored as revisits.
LEAST_SHARED = 100


class WarcError(ValueError):
    """An archive or a record that breaks the format."""


def frame_archive(records: list[bytes], samples: list[bytes]) -> bytes:
    """The archive's bytes: the dictionary's skippable frame, then a frame for each record."""
    used, total = [], 0
    for s in samples[:TRAIN_PAYLOADS]:
        if total >= TRAIN_BYTES:
            break
        used.append(s[: TRAIN_BYTES - total])
        total += len(used[-1])
    try:
        trained = zstandard.train_dictionary(DICT_BYTES, [s for s in used if s]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        trained = b""  # too few samples: an empty dictionary frame
    shared = zstandard.ZstdCompressionDict(trained) if trained else None
    packed = zstandard.ZstdCompressor(level=LEVEL).compress(trained) if trained else b""
    out = [struct.pack("<II", DICT_FRAME, len(packed)), packed]
    pack = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True, write_content_size=True)
    out += [pack.compress(r) for r in records]
    return b"".join(out)


def read_frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one for each frame; the dictionary's frame may be left out."""
    if len(data) < 8:
        raise WarcError("not an archive")
    magic, size = struct.unpack_from("<II", data)
    begin = 8 + size
    if magic == FRAME_MAGIC:  # no dictionary: records from the start
        begin, size = 0, 0
    elif magic != DICT_FRAME or begin > len(data):
        raise WarcError("no dictionary in the leading frame")
    raw = data[8 : 8 + size]
    if raw[:4] == struct.pack("<I", FRAME_MAGIC):
        raw = zstandard.ZstdDecompressor().decompress(raw)
    if raw and raw[:4] != struct.pack("<I", DICT_MAGIC):
        raise WarcError("the leading frame holds no dictionary")
    shared = zstandard.ZstdCompressionDict(raw) if raw else None
    unpack, at, view = zstandard.ZstdDecompressor(dict_data=shared), begin, memoryview(data)
    while at < len(data):
        one, parts, start = unpack.decompressobj(), [], at
        while not one.eof:
            if at >= len(data):
                raise WarcError(f"frame at {start} is cut off")
            fed = view[at : at + FEED]
            try:
                parts.append(one.decompress(fed))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame at {start}: {e}") from e
            at += len(fed) - len(one.unused_data)
        yield b"".join(parts)


def digest32(data: bytes) -> str:
    return "sha256:" + base64.b32encode(hashlib.sha256(data).digest()).decode()


@dataclass
class Record:
    """A parsed record: its headers, HTTP headers and payload (revisits: none)."""

    headers: dict[str, str]
    http: dict[str, str] = field(default_factory=dict)
    payload: bytes = b""


_DATE = "2000-01-01T00:00:00Z"


def record_id(page_id: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header value: control characters and line ends go, other characters stay."""
    return "".join(c for c in value if c >= " " and c != "\x7f").strip()


def build_record(page_id: int, url: str | None, payload: bytes | None, length: int, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit (``refers_to``) without payload; ``digest``: hex SHA-256."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", _clean(url or "") or "about:blank"),
        ("WARC-Payload-Digest", "sha256:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("WARC-Block-Digest", digest32(block)),
        ("X-Page-ID", str(page_id)),
    ]
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(refers_to)), ("X-Refers-To-Page-ID", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n").encode() + block + b"\r\n\r\n"


def _headers(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise WarcError(f"bad header line {line[:60]!r}")
        out[name.decode().strip().lower()] = value.decode().strip()
    return out


def parse_record(raw: bytes) -> Record:
    """Parse and validate a record: version, mandatory headers, lengths and digests."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise WarcError("not a WARC record")
    headers = _headers(lines[1:])
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise WarcError(f"no {name}")
    if not headers["content-length"].isdecimal():
        raise WarcError("bad content-length")
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise WarcError("the block's length differs from content-length")
    block = rest[:size]
    if headers.get("warc-block-digest", digest32(block)) != digest32(block):
        raise WarcError("the block's digest differs")
    record = Record(headers)
    if headers["warc-type"] in ("response", "revisit") and headers.get("content-type", "").startswith("application/http"):
        top, gap, payload = block.partition(b"\r\n\r\n")
        if not gap or not top.startswith(b"HTTP/"):
            raise WarcError("no HTTP headers")
        record.http, record.payload = _headers(top.split(b"\r\n")[1:]), payload
        if headers["warc-type"] == "response":
            if int(record.http.get("content-length", len(payload))) != len(payload):
                raise WarcError("the payload's length differs")
            if headers.get("warc-payload-digest", digest32(payload)) != digest32(payload):
                raise WarcError("the payload's digest differs")
        elif payload:
            raise WarcError("a revisit holds a payload")
    return record


def _write(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records, samples, held, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            address = put(folder, f"pages-{seq:05d}.warc.zst", frame_archive(records, samples))
            return pa.RecordBatch.from_arrays([pa.array([address]), pa.array([len(records)])], ["path", "records"])

        for batch in batches:
            for row in zip(*batch.columns):
                page_id, url, payload, length, digest, refers_to = (x.as_py() for x in row)
                records.append(build_record(page_id, url, payload, length, digest, refers_to))
                if payload and sum(map(len, samples[-1:])) < TRAIN_BYTES and len(samples) < TRAIN_PAYLOADS:
                    samples.append(payload[:65536])
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    records, samples, held, seq = [], [], 0, seq + 1
        if records:
            yield flush()

    return run


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page; returns the manifest (path, records).

    The payload is the html in UTF-8 (null: empty). Of pages with equal
    payloads of at least 100 bytes the one with the smallest id is a response,
    the others are revisits of it; repeated rows of that id are all responses.
    A null url is written as about:blank; rows without an id are not written;
    other columns are not carried.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), html.alias("html"), F.length(html).cast("long").alias("length"), F.sha2(html, 256).alias("digest")).filter("page_id is not null")
    long = rows.filter(F.col("length") >= LEAST_SHARED).select("page_id", "digest")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    marks = join_keyed(long, materialize(first, "digests"), "digest", "n").filter("page_id <> first").select("page_id", "digest", "first").distinct()
    # payloads travel once, by page id and digest, never gathered by a hot digest
    marked = rows.join(marks, ["page_id", "digest"], "left")
    marked = marked.select("page_id", "url", F.when(F.col("first").isNull(), F.col("html")).alias("html"), "length", "digest", F.col("first").alias("refers_to"))
    return materialize(marked.mapInArrow(_write(new_folder(spark, "warc")), "path string, records long"), "manifest")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            out: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")}
            for raw in read_frames(get(path)):
                r = parse_record(raw)
                target = r.headers.get("x-refers-to-page-id")
                out["page_id"].append(int(r.headers["x-page-id"]))
                out["payload_bytes"].append(len(r.payload) if r.headers["warc-type"] == "response" else int(r.http["content-length"]))
                out["payload_digest"].append(base64.b32decode(r.headers["warc-payload-digest"].partition(":")[2]).hex())
                out["record_type"].append(r.headers["warc-type"])
                out["refers_to"].append(None if target is None else int(target))
                out["url"].append(r.headers["warc-target-uri"])
            if len(out["page_id"]) != expected:
                raise WarcError(f"{path} holds {len(out['page_id'])} records; {expected} were written")
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


def read_archives(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url) of each record."""
    width = shuffle_width(manifest.sparkSession)
    return manifest.repartition(width, "path").mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")


def op8_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"))).drop("url")
