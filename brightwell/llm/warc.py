"""WARC archives with Zstandard: a dictionary in the leading skippable frame, one frame per record.

Pages become response records, or revisit records where an earlier page has
the same payload. Readers take the dictionary from the file itself, decode
frame by frame and hold each record against its own headers and digests.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, key_filter, open_bytes, put_bytes, qualified, scratch, written

#: Payloads below this many bytes are stored each time.
REVISIT_BYTES = 100
#: Magic of the skippable frame that holds the dictionary.
DICT_FRAME, ZSTD_FRAME = 0x184D2A5D, 0xFD2FB528
LEVEL, DICT_BYTES = 3, 32_768
#: Bounds of the dictionary's sample on the driver: pages, bytes of each. Only compression depends on it.
SAMPLE_PAGES, SAMPLE_BYTES = 400, 16_384
#: Uncompressed bytes after which a file ends; bounds a writer's memory.
FILE_BYTES = 64 << 20
CHUNK = 1 << 16
DATE = "2000-01-01T00:00:00Z"

DIGESTS = "page_id bigint, payload_bytes bigint, payload_digest string"
FILES = "path string, records bigint, bytes bigint"
RECORDS = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


class WarcError(ValueError):
    """A file or record that does not hold what it says."""


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str) -> int | None:
    m = re.fullmatch(r"<urn:page:(none|-?\d+)>", urn)
    if not m:
        raise WarcError(f"record id {urn!r}")
    return None if m[1] == "none" else int(m[1])


def _header_value(text: str) -> str:
    """Control characters cannot stand in a header line; they are percent-encoded, as is the percent sign before them."""
    return re.sub(r"[\x00-\x1f\x7f%]", lambda m: f"%{ord(m[0]):02X}", text)


def _unheader(text: str) -> str:
    return re.sub(r"%([01][0-9A-F]|7F|25)", lambda m: chr(int(m[1], 16)), text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit's block has the HTTP header only; the full payload's size and digest are in its headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_header_value(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        *([f"WARC-Refers-To: {_urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"] if revisit else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[int | None, str | None, int, str, str, int | None, bytes]:
    """(page_id, url, payload_bytes, payload_digest, type, refers_to, payload) of a record; WarcError if anything in it disagrees."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or lines[0] != "WARC/1.1":
        raise WarcError("no WARC/1.1 header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(": ")
        if not colon or name.lower() in fields:
            raise WarcError(f"header line {line!r}")
        fields[name.lower()] = value
    try:
        kind, size = fields["warc-type"], int(fields["content-length"])
        page_id, digest = _page(fields["warc-record-id"]), fields["warc-payload-digest"].removeprefix("sha256:")
        block_digest = fields["warc-block-digest"]
        fields["warc-date"]
    except (KeyError, ValueError) as e:
        raise WarcError(f"header {e}") from e
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise WarcError(f"Content-Length {size}, but {len(rest) - 4} bytes")
    if block_digest != f"sha256:{hashlib.sha256(block).hexdigest()}":
        raise WarcError("block digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not http.startswith(b"HTTP/1.1 ") or not length:
        raise WarcError("no HTTP header")
    n = int(length[1])
    url = _unheader(fields["warc-target-uri"]) if "warc-target-uri" in fields else None
    if kind == "revisit":
        if payload:
            raise WarcError("a revisit with a payload")
        return page_id, url, n, digest, kind, _page(fields.get("warc-refers-to", "")), b""
    if kind != "response":
        raise WarcError(f"record type {kind!r}")
    if len(payload) != n or hashlib.sha256(payload).hexdigest() != digest:
        raise WarcError("payload length or digest")
    return page_id, url, n, digest, kind, None, payload


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_FRAME, len(dictionary)) + dictionary


def read_records(f) -> Iterator[bytes]:
    """The records of an open file: the dictionary from the leading skippable frame, then a frame each."""
    head = f.read(8)
    if len(head) < 8 or struct.unpack("<I", head[:4])[0] != DICT_FRAME:
        raise WarcError("no leading dictionary frame")
    size = struct.unpack("<I", head[4:])[0]
    raw = f.read(size)
    if len(raw) != size:
        raise WarcError("truncated dictionary frame")
    if raw[:4] == struct.pack("<I", ZSTD_FRAME):  # the dictionary may itself be compressed
        raw = zstandard.ZstdDecompressor().decompress(raw)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    rest = b""
    while rest or (rest := f.read(CHUNK)):
        frame, parts = reader.decompressobj(), []
        while not frame.eof:
            if not rest and not (rest := f.read(CHUNK)):
                raise WarcError("truncated frame")
            try:
                parts.append(frame.decompress(rest))
            except zstandard.ZstdError as e:
                raise WarcError(f"frame: {e}") from e
            rest = frame.unused_data
        yield b"".join(parts)


def digests(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest of each page; null html is an empty payload."""
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.octet_length(html).cast("bigint").alias("payload_bytes"), F.sha2(html, 256).alias("payload_digest"))


def revisits(known: DataFrame, *, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, refers_to: the pages whose payload, of `least` bytes or more, a page with a smaller id has."""
    large = known.where(F.col("payload_bytes") >= least)
    # max of a null-safe id: a null page_id refers to the others of its payload, never the other way round
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return large.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "payload_digest", "refers_to")


def train(pages: DataFrame) -> bytes:
    """A dictionary from the pages whose ids hash lowest; empty if there are too few."""
    small = pages.where((F.octet_length("html") > 0) & (F.octet_length("html") <= SAMPLE_BYTES)).withColumn("o", F.xxhash64("page_id"))
    # Ids first, so that each task ranks ids and only the sample's texts move.
    chosen = small.select("page_id", "o").orderBy("o", "page_id").limit(SAMPLE_PAGES).select("page_id").distinct()
    texts = small.select("page_id", F.encode("html", "UTF-8").alias("b")).join(F.broadcast(chosen), "page_id").collect()
    texts = [bytes(r["b"]) for r in sorted(texts, key=lambda r: (r["page_id"], bytes(r["b"])))]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except zstandard.ZstdError:
        return b""


def write(pages: DataFrame, folder: str, *, least: int = REVISIT_BYTES, file_bytes: int = FILE_BYTES, dictionary: bytes | None = None) -> DataFrame:
    """Write all pages into archives under folder; path, records and bytes of each file.

    Two passes: the first takes digests and finds what is a revisit, without
    payloads; the second writes. Only pages that may be revisits, by a key
    filter, are joined with them, so other payloads do not move. A file's name
    holds the task attempt and only attempts that ended well are listed.
    """
    spark = pages.sparkSession
    folder = qualified(spark, folder)
    rule = written(revisits(written(digests(pages), "warc-digests"), least=least).groupBy("page_id", "payload_digest").agg(F.min("refers_to").alias("refers_to")), "warc-revisits")
    test = key_filter(rule.select(F.xxhash64("page_id", "payload_digest").alias("k")))
    raw = spark.sparkContext.broadcast(train(pages) if dictionary is None else dictionary)
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload")).withColumn("digest", F.sha2("payload", 256))
    rows = rows.withColumn("again", test(F.xxhash64("page_id", "digest")))
    some = rows.where("again").drop("again")
    names = ["page_id", "url", "payload", "digest"]
    by = rule.select(F.col("page_id").alias("of"), "payload_digest", "refers_to")
    met = some.join(by, some["page_id"].eqNullSafe(by["of"]) & (some["digest"] == by["payload_digest"]), "left").select(*names, "refers_to")
    marked = rows.where("not again").select(*names, F.lit(None).cast("bigint").alias("refers_to")).unionByName(met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        kind = zstandard.ZstdCompressionDict(raw.value) if raw.value else None
        compress = zstandard.ZstdCompressor(level=LEVEL, dict_data=kind, write_checksum=True, write_content_size=True).compress
        done, frames, size = [], [dictionary_frame(raw.value)], 0

        def flush() -> None:
            nonlocal size, frames
            path = f"{folder}/part-{part:05d}-{len(done):05d}-{attempt}.warc.zst"
            done.append((path, len(frames) - 1, put_bytes(path, frames)))
            frames, size = [dictionary_frame(raw.value)], 0

        for b in batches:
            for page_id, url, payload, digest, refers in zip(*(b.column(k).to_pylist() for k in range(5))):
                frames.append(compress(record(page_id, url, payload, digest, refers, refers is not None)))
                size += len(payload)
                if size >= file_bytes:
                    flush()
        if len(frames) > 1:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), *(pa.array([d[k] for d in done], pa.int64()) for k in (1, 2))], names=["path", "records", "bytes"])

    return written(marked.transform(bounded_batches).mapInArrow(run, FILES), "warc-files")


def read(files: DataFrame, *, payloads: bool = False) -> DataFrame:
    """The records of the listed files, one task for some files each; with payloads, also the html of responses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
        keep = 7 if payloads else 6

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(keep)], names=names[:keep])

        for b in batches:
            for path, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                rows, seen, size = [], 0, 0
                with open_bytes(path) as f:
                    for data in read_records(f):
                        rows.append(parse(data)[:keep])
                        seen += 1
                        size += len(data) if payloads else 0
                        if len(rows) >= 5000 or size >= FILE_BYTES:
                            yield batch(rows)
                            rows, size = [], 0
                if seen != n:
                    raise WarcError(f"{path}: {seen} records instead of {n}")
                yield batch(rows)

    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return files.select("path", "records").repartition(parts, "path").transform(bounded_batches).mapInArrow(run, RECORDS + (", payload binary" if payloads else ""))


def checked(records: DataFrame) -> DataFrame:
    """The records read (a written table); an error if a revisit names no response with its digest."""
    named = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest", F.lit(True).alias("found")).distinct()
    again = records.where("record_type = 'revisit'").join(named, ["refers_to", "payload_digest"], "left")
    digest = F.when(F.col("found"), F.col("payload_digest")).otherwise(F.raise_error(F.format_string("page %d is no response with the digest of its revisit", "refers_to")))
    return records.where("record_type <> 'revisit'").unionByName(again.withColumn("payload_digest", digest).select(*records.columns))


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write every page and read the archives back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, a null url is left out. Of equal payloads
    of REVISIT_BYTES or more the smallest page_id is the response; rows that
    repeat that id are responses, too. Pages without an id are revisits where
    another page has the payload. Other columns are not written. An empty
    table gives no file and an empty result.
    """
    files = write(pages, folder or scratch(pages.sparkSession, "warc-data"))
    records = written(read(files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"), "warc-records")
    return checked(records)
