"""WARC archives in Zstandard: a dictionary in a leading skippable frame, one frame per record."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from airq.llm.common import NO_ID, keyed, least_hashed, store, unkeyed

#: Fixed values of the formats.
DICTIONARY_FRAME = 0x184D2A5D
ZSTD_FRAME = 0xFD2FB528
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: The dictionary is trained on this many payloads at most, of so many bytes at most.
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 500, 65_536, 32_768
#: Uncompressed bytes after which a writer begins the next archive.
ARCHIVE_BYTES = 4 << 20
FEED = 8_192

RECORD = "page_id long, record_type string, uri string, refers_to long, payload_digest string, payload binary, problem string"


def train_dictionary(pages: DataFrame, sample: int = SAMPLE_PAGES) -> bytes:
    """A Zstandard dictionary from the payloads whose hashes are least; empty where there is too little to learn from."""
    rows = pages.where(F.octet_length("html") <= SAMPLE_BYTES).select(F.xxhash64("html").alias("h"), F.col("html").alias("t"))
    # Equal payloads have equal hashes and count once.
    samples = [r.t.encode() for r in least_hashed(rows, sample).dropDuplicates(["h"]).orderBy("h").collect()]
    if sum(map(len, samples)) < 20 * DICTIONARY_BYTES or len(samples) < 20:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def _record(page: dict, date: str) -> bytes:
    revisit = page["refers_to"] is not None
    payload = b"" if revisit else page["payload"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {page['payload_bytes']}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page['page_id']}>",
            f"WARC-Date: {date}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{page['digest']}",
            f"Content-Length: {len(http) + len(payload)}"]
    if page["url"] is not None:
        head.append("WARC-Target-URI: " + quote(page["url"], safe="/:?#[]@!$&'()*+,;=~-._"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{page['refers_to']}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def write_archives(pages: DataFrame, dictionary: bytes, date: str = "2020-01-01T00:00:00Z", least: int = 100) -> DataFrame:
    """(path, length, content) of archives that hold one record per page_id.

    The payload is ``html`` in UTF-8, a null one is empty. Of pages with equal payloads of ``least`` bytes or more the
    one with the smallest page_id is a response and the others are revisits of it; all others are responses. The shape
    is that of Spark's ``binaryFile`` source, so archives from there are read alike. A missing url leaves its header
    out. Repeated page_ids count as one page (the greatest html and url), a null page_id as one page that comes first.
    """
    rows = keyed(pages.select("page_id", F.struct("html", "url").alias("page")), "page_id", "page").select(
        "page_id", "page.url", F.encode(F.coalesce("page.html", F.lit("")), "UTF-8").alias("payload")).withColumns(
        {"digest": F.sha2("payload", 256), "payload_bytes": F.octet_length("payload")})
    same, _ = store(rows.where(F.col("payload_bytes") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                    .where("n > 1").select("digest", "first"), "equal-payloads")
    flagged = rows.join(same, "digest", "left").withColumn("refers_to", F.when(F.col("page_id") != F.col("first"), F.col("first"))).drop("first")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trained = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=6, dict_data=trained, write_checksum=True, write_content_size=True)
        begin = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
        part, number, held, size = TaskContext.get().partitionId(), 0, [begin], 0

        def archive() -> pa.RecordBatch:
            content = b"".join(held)
            return pa.RecordBatch.from_pylist([{"path": f"part-{part:05d}-{number:05d}.warc.zst", "length": len(content), "content": content}])

        for batch in batches:
            for i in range(batch.num_rows):
                record = _record(batch.slice(i, 1).to_pylist()[0], date)
                held.append(packer.compress(record))
                size += len(record)
                if size >= ARCHIVE_BYTES:
                    yield archive()
                    number, held, size = number + 1, [begin], 0
        if size:
            yield archive()

    return flagged.select("page_id", "url", "payload", "digest", "payload_bytes", "refers_to").mapInArrow(
        task, "path string, length long, content binary")


def frames(content: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive, each with the dictionary of the leading frame; ValueError where it breaks off."""
    view = memoryview(content)
    magic, size = struct.unpack("<II", view[:8]) if len(view) >= 8 else (0, 0)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    if 8 + size > len(view):
        raise ValueError("dictionary frame breaks off")
    dictionary, at = bytes(view[8:8 + size]), 8 + size
    if dictionary[:4] == struct.pack("<I", ZSTD_FRAME):
        dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    while at < len(view):
        one, out = reader.decompressobj(), []
        while not one.eof:
            if at >= len(view):
                raise ValueError("frame breaks off")
            try:
                out.append(one.decompress(view[at:at + FEED]))
            except zstandard.ZstdError as error:
                raise ValueError(f"frame is damaged: {error}") from None
            at = min(at + FEED, len(view))
        at -= len(one.unused_data)
        yield b"".join(out)


def parse_record(record: bytes) -> dict:
    """One record's fields, with what is wrong with it under ``problem``."""
    out = dict.fromkeys(["page_id", "record_type", "uri", "refers_to", "payload_digest", "payload", "problem"])
    head, gap, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    named = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    if not gap or not re.fullmatch(r"WARC/1\.\d", lines[0]):
        return out | {"problem": "no WARC header"}
    ids = {k: re.fullmatch(r"<urn:page:(-?\d+)>", named.get(k, "")) for k in ("warc-record-id", "warc-refers-to")}
    length = named.get("content-length", "")
    out |= {"record_type": named.get("warc-type"), "page_id": ids["warc-record-id"] and int(ids["warc-record-id"][1]),
            "refers_to": ids["warc-refers-to"] and int(ids["warc-refers-to"][1]),
            "uri": unquote(named["warc-target-uri"]) if "warc-target-uri" in named else None,
            "payload_digest": named.get("warc-payload-digest", "").removeprefix("sha256:")}
    if not length.isascii() or not length.isdigit():
        return out | {"problem": "no Content-Length"}
    if rest[int(length):] != b"\r\n\r\n" or len(rest) != int(length) + 4:
        return out | {"problem": "Content-Length is not the block's"}
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    body = re.search(rb"(?im)^content-length: *(\d+)", http)
    if not gap or not body:
        return out | {"problem": "no HTTP header"}
    if out["page_id"] is None or out["record_type"] not in ("response", "revisit"):
        return out | {"problem": "no known record id or type"}
    if out["record_type"] == "revisit":
        return out | {"problem": "a revisit refers to no record" if out["refers_to"] is None else None}
    if int(body[1]) != len(payload) or hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        return out | {"problem": "the payload is not that of its header"}
    return out | {"payload": payload}


def read_archives(archives: DataFrame) -> DataFrame:
    """Records of archives (content binary): page_id, record_type, uri, refers_to, payload_digest, payload, problem.

    A record with a wrong header, length or digest has a ``problem`` and no payload; where an archive breaks off or is
    none, one row tells so. Null content has no records. Each archive is decoded record by record.
    """
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def out(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

        for batch in batches:
            for content in batch.column("content"):
                rows, size = [], 0
                try:
                    for record in frames(content.as_py()) if content.is_valid else ():
                        rows.append(parse_record(record))
                        size += len(record)
                        if size >= 1 << 20:
                            yield out(rows)
                            rows, size = [], 0
                except ValueError as broken:
                    rows.append(dict.fromkeys(names) | {"problem": str(broken)})
                yield out(rows)

    return archives.select("content").mapInArrow(task, RECORD)


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, problem): revisits with the size of their response.

    ``records`` are those of :func:`read_archives`. A revisit whose response is missing or has another digest has a
    ``problem`` and no size.
    """
    rows, _ = store(records.select("page_id", "record_type", "refers_to", "payload_digest", "problem",
                                   F.octet_length("payload").cast("long").alias("payload_bytes")), "records")
    visits = rows.where("record_type = 'revisit'").drop("payload_bytes")
    answers = rows.where("record_type = 'response' and problem is null").select(
        F.col("page_id").alias("of"), F.col("payload_digest").alias("digest"), "payload_bytes")
    found = visits.join(answers, F.col("refers_to") == F.col("of"), "left").withColumn(
        "problem", F.coalesce("problem", F.when(F.col("digest").eqNullSafe(F.col("payload_digest")), None).otherwise("no equal response")))
    every = rows.where("record_type is null or record_type <> 'revisit'").unionByName(found.drop("of", "digest"))
    return every.select(unkeyed("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.nullif(F.col("refers_to"), F.lit(NO_ID)).alias("refers_to"), "problem")
