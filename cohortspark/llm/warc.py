"""WARC archives under Zstandard: one frame a record, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, shared_dir, text_batches

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Bytes of records after which a task starts another archive, bytes of its first records that its dictionary is made
#: from, and bytes of the dictionary. Both bounds are an archive's own: each archive carries the dictionary of its records.
ARCHIVE_BYTES, SAMPLE_BYTES, DICTIONARY_BYTES = 64 << 20, 2 << 20, 32 << 10


class WarcError(ValueError):
    """An archive that isn't what it should be: where, and what is wrong."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, digest: str | None = None) -> bytes:
    """One WARC record of a page: a response with its payload, or, with refers_to, a revisit with the HTTP header alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f<>]", lambda m: f"%{ord(m[0]):02X}", url) if url else f"urn:page:{page_id}"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest or sha1_base32(payload)}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
        *([("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", REVISIT_PROFILE)] if refers_to is not None else []),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    return (VERSION + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes, where: str) -> dict:
    """The headers and payload of a record; raises WarcError unless headers, lengths and digests hold."""
    head, split, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not split or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise WarcError(f"{where}: no WARC header but {raw[:20]!r}")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"{where}: no header field: {line[:80]!r}")
        if name.lower() in fields:
            raise WarcError(f"{where}: {name} comes twice")
        fields[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise WarcError(f"{where}: {name} is missing")
    if not fields["content-length"].isascii() or not fields["content-length"].isdigit():
        raise WarcError(f"{where}: Content-Length is {fields['content-length']!r}")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise WarcError(f"{where}: Content-Length is {length}, the block and its end take {len(rest)}")
    block = rest[:length]
    if (want := fields.get("warc-block-digest")) and want != f"sha1:{sha1_base32(block)}":
        raise WarcError(f"{where}: the block's digest isn't {want}")
    out = {"fields": fields, "block": block, "payload": None, "payload_bytes": None}
    if fields.get("content-type", "").startswith("application/http"):
        http, split, payload = block.partition(b"\r\n\r\n")
        if not split or not http.startswith(b"HTTP/"):
            raise WarcError(f"{where}: no HTTP header in the block")
        said = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
        out["payload_bytes"] = int(said[1]) if said else len(payload)
        if fields["warc-type"] == "response":
            out["payload"] = payload
            if len(payload) != out["payload_bytes"]:
                raise WarcError(f"{where}: HTTP Content-Length is {out['payload_bytes']}, the payload has {len(payload)}")
            if (want := fields.get("warc-payload-digest")) and want != f"sha1:{sha1_base32(payload)}":
                raise WarcError(f"{where}: the payload's digest isn't {want}")
        elif fields["warc-type"] == "revisit" and payload:
            raise WarcError(f"{where}: a revisit with a payload")
    return out


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A Zstandard dictionary of the samples; b"" where there are too few or too short ones to train on."""
    try:
        return zstandard.train_dictionary(size, samples, level=3).as_bytes() if len(samples) >= 16 else b""
    except zstandard.ZstdError:
        return b""


class ArchiveWriter:
    """Writes records to one archive: the dictionary frame, then a frame with its content size and checksum for each."""

    def __init__(self, sink, dictionary: bytes, level: int = 3):
        self.sink, self.bytes, self.records = sink, 0, 0
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT) if dictionary else None
        self.press = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True, write_content_size=True)
        if dictionary:
            packed = zstandard.ZstdCompressor(level=level).compress(dictionary)
            self._put(struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.bytes += len(data)

    def write(self, record: bytes) -> None:
        self._put(self.press.compress(record))
        self.records += 1


def read_archive(stream, name: str, chunk: int = 1 << 18, most: int = 1 << 31) -> Iterator[dict]:
    """The records of an archive, one frame each, in bounded memory: a chunk of input and a record at a time.

    The leading frame, if it is skippable, holds the dictionary, plain or as a Zstandard frame of its own. Raises WarcError
    on anything that isn't whole: a frame that ends early or holds more than `most` bytes, a wrong checksum, content size,
    magic or header, skippable frames elsewhere, a dictionary whose id isn't the one the records name.
    """
    data = stream.read(8)
    dictionary = None
    if len(data) >= 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE_MAGIC:
        length = struct.unpack("<I", data[4:])[0]
        body = stream.read(length)
        if len(body) != length:
            raise WarcError(f"{name}: the dictionary frame ends after {len(body)} of {length} bytes")
        if body[:4] == struct.pack("<I", FRAME_MAGIC):
            body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 26)
        dictionary, data = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT), b""
    open_ = zstandard.ZstdDecompressor(dict_data=dictionary)
    place = 0
    while True:
        if len(data) < 18:
            data += stream.read(chunk)
        if not data:
            return
        where = f"{name}, record {place}"
        if data[:4] != struct.pack("<I", FRAME_MAGIC):
            raise WarcError(f"{where}: no Zstandard frame but {data[:4]!r}")
        said = zstandard.get_frame_parameters(data)
        if said.dict_id and said.dict_id != (dictionary.dict_id() if dictionary else 0):
            raise WarcError(f"{where}: it needs dictionary {said.dict_id}")
        frame, parts, size = open_.decompressobj(), [], 0
        try:
            while True:
                parts.append(frame.decompress(data))
                size += len(parts[-1])
                if size > most:
                    raise WarcError(f"{where}: more than {most} bytes")
                if frame.eof:
                    break
                if not (data := stream.read(chunk)):
                    raise WarcError(f"{where}: the frame ends early")
        except zstandard.ZstdError as e:
            raise WarcError(f"{where}: {e}") from e
        data, raw = frame.unused_data, b"".join(parts)
        if said.content_size != zstandard.CONTENTSIZE_UNKNOWN and said.content_size != len(raw):
            raise WarcError(f"{where}: {len(raw)} bytes instead of {said.content_size}")
        yield parse_record(raw, where)
        place += 1


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """pages (page_id, url, html) as records in archives under `folder`, a URI that executors share; returns the archives
    written: path, records, bytes.

    Of pages with equal html the one with the largest page_id becomes a response and the others revisit it (null page_ids
    revisit too, unless all are null; rows that repeat that page_id are responses as well). Null html is an empty payload,
    null url a urn. Equality is found by SHA-1 over all pages in one pass that moves digests only; only digests with two or
    more pages are joined back, so pages don't move unless those are many, and a digest with a large part of all pages is
    split by Spark's skew handling, as both sides of that join are shuffled as they are.

    Each task streams its pages to files of its own, named by chance, of about archive_bytes. The paths returned are the
    result: what a lost or repeated attempt left behind is in no row and is never read.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    pages = text_batches(pages).select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"), F.sha1(payload.cast("binary")).alias("_sha1"))
    groups = pages.groupBy("_sha1").agg(F.count(F.lit(1)).alias("_n"), F.max("page_id").alias("_response"), F.count("page_id").alias("_ids"))
    groups = checkpointed(groups.where("_n > 1 and _ids > 0").select("_sha1", "_response"))
    pages = pages.join(groups, "_sha1", "left")
    pages = pages.select("page_id", "url", "html", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("_response")), F.col("_response")).alias("refers_to"))

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, root = pafs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        done, held, held_bytes, writer, sink, name = [], [], 0, None, None, ""

        def begin() -> None:
            nonlocal writer, sink, name
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"
            sink = system.open_output_stream(name)
            writer = ArchiveWriter(sink, train_dictionary(held))
            for record in held:
                writer.write(record)
            held.clear()

        def end() -> None:
            nonlocal writer, held_bytes
            sink.close()
            done.append((name, writer.records, writer.bytes))
            writer, held_bytes = None, 0

        for batch in batches:
            for page_id, url, html, refers_to in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"]):
                record = record_bytes(None if pd.isna(page_id) else int(page_id), url, html.encode(), None if pd.isna(refers_to) else int(refers_to))
                if writer is None:
                    held.append(record)
                    held_bytes += len(record)
                    if held_bytes >= SAMPLE_BYTES:
                        begin()
                else:
                    writer.write(record)
                    if writer.bytes >= archive_bytes:
                        end()
        if held:
            begin()
        if writer is not None:
            end()
        yield pd.DataFrame(done, columns=["path", "records", "bytes"])

    return checkpointed(pages.mapInPandas(write, "path string, records long, bytes long"))


def read_archives(archives: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """The records of archives (path, records, as write_archives returns them), each archive streamed by one task.

    Returns record_type, page_id, refers_to, url, payload_bytes, payload_digest and, with payloads, payload (binary; null for
    revisits). Raises WarcError if an archive is broken or holds another number of records than `records` says.
    """

    def load(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = pafs.FileSystem.from_uri(folder)
        ids = lambda s: int(s[10:-1]) if s and s != "<urn:page:>" else None
        for batch in batches:
            for path, records in zip(batch["path"], batch["records"]):
                rows, size, seen = [], 0, 0
                with system.open_input_stream(path) as stream:
                    for r in read_archive(stream, path):
                        f = r["fields"]
                        rows.append((f["warc-type"], ids(f["warc-record-id"]), ids(f.get("warc-refers-to")), f.get("warc-target-uri"), r["payload_bytes"], f["warc-payload-digest"].removeprefix("sha1:"), *([r["payload"]] if payloads else [])))
                        seen, size = seen + 1, size + len(r["block"]) * payloads
                        if len(rows) >= 4096 or size > 1 << 24:
                            yield frame(rows)
                            rows, size = [], 0
                if seen != records:
                    raise WarcError(f"{path}: {seen} records instead of {records}")
                yield frame(rows)

    def frame(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"page_id": "Int64", "refers_to": "Int64"})

    names = ["record_type", "page_id", "refers_to", "url", "payload_bytes", "payload_digest", *(["payload"] if payloads else [])]
    schema = "record_type string, page_id long, refers_to long, url string, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    n = max(1, archives.count())
    return archives.repartition(n, "path").mapInPandas(load, schema)


def archive_folder(spark) -> str:
    """A new folder for archives in the shared one."""
    where = shared_dir(spark)
    return f"{where if '://' in where or where.startswith('file:') else 'file://' + where}/warc-{uuid.uuid4().hex}"
