"""Web archives whose records are Zstandard frames that share a dictionary.

A dictionary is built from a bounded number of records and leads each file as a skippable frame; every record is a frame of its own,
so that one can be read by its offset. Of pages with equal payloads one is stored as a response, the others as revisits of it.
Tasks write files under names of their own and report them; only files of successful attempts get into the index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from incidentry.llm.common import attempt_name, bytes_of, fresh, key_kind, open_folder, scratch_path, stored

# Fixed values of the file format.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_DATE = "2024-01-01T00:00:00Z"

DICTIONARY_BYTES, SAMPLE_ROWS, SAMPLE_BYTES = 112_640, 1024, 16_384
FILE_BYTES = 256 << 20


def digest(data: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, payload_digest: str, first) -> bytes:
    """A response, or a revisit of page ``first`` whose body has the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http + payload if first is None else http
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {name}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head += [f"WARC-Date: {RECORD_DATE}", f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """A record's header fields, its HTTP header fields and the payload that it holds."""
    fields, _, rest = data.partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in fields.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(named["Content-Length"])].partition(b"\r\n\r\n")
    return named, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def train(pages: DataFrame, id: str, html: str) -> bytes:
    """A dictionary from at most SAMPLE_ROWS records of at most SAMPLE_BYTES each, spread over the table; empty if too little is there."""
    count = pages.count()
    share = F.pmod(F.xxhash64(F.col(f"`{id}`")), F.lit(max(1, count // SAMPLE_ROWS))) == 0
    rows = pages.where(share).select(F.substring(F.encode(F.col(f"`{html}`"), "UTF-8"), 1, SAMPLE_BYTES)).limit(SAMPLE_ROWS).collect()
    samples = [record(i, "", bytes(row[0] or b""), digest(b""), None) for i, row in enumerate(rows)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) < 16 or size < 1024:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


def _first_ids(pages: DataFrame, id: str, html: str, least: int) -> DataFrame:
    """(hash, first): smallest id of every payload of at least ``least`` bytes that occurs more than once, told apart by SHA-256."""
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    narrow = pages.where(F.octet_length(payload) >= least).select(F.sha2(payload, 256).alias("hash"), F.col(f"`{id}`").alias("id"))
    return narrow.groupBy("hash").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")


def write(pages: DataFrame, folder: str, least: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write one record per row below ``folder`` and return the index: id, file, offset, length (of the frame), record_type.

    A null html is an empty payload. Of equal payloads of at least ``least`` bytes the rows with the smallest id are responses and the
    others revisits of it, also rows with a null id; if all ids are null, all are responses. A null url leaves out the target field. Ids are
    whole numbers or anything that can be written as text and read back from it.
    """
    spark = pages.sparkSession
    dictionary = train(pages, id, html)
    hash_name, first_name = fresh(pages, "_hash", "_first")
    firsts = _first_ids(pages, id, html, least).select(F.col("hash").alias(hash_name), F.col("first").alias(first_name))
    payload = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.withColumn(hash_name, F.sha2(payload, 256)).join(firsts, hash_name, "left")
    other = ~F.col(f"`{id}`").eqNullSafe(F.col(first_name))
    kind = pages.select(id).dtypes[0][1]
    written = key_kind(kind)
    rows = rows.select(
        F.col(f"`{id}`").cast(written).alias("id"),
        F.col(f"`{url}`").alias("url"),
        F.col(f"`{html}`").alias("html"),
        F.when(other, F.col(first_name)).cast(written).alias("first"),
    )

    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=True)
        files, root = open_folder(folder)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                index: list = []
                ids, urls, firsts = (batch.column(i).to_pylist() for i in (0, 1, 3))
                for key, link, data, first in zip(ids, urls, bytes_of(batch.column(2)), firsts):
                    if out is None or at >= FILE_BYTES:
                        if out is not None:
                            out.close()
                        name = attempt_name("pages", ".warc.zst")
                        out = files.open_output_stream(f"{root}/{name}", compression=None)
                        at = out.write(struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary) if dictionary else 0
                    data = data or b""
                    frame = packer.compress(record(key, link, data, digest(data), first))
                    index.append((key, name, at, len(frame), "response" if first is None else "revisit"))
                    at += out.write(frame)
                yield pa.RecordBatch.from_pylist(
                    [dict(zip(("id", "file", "offset", "length", "record_type"), row)) for row in index], schema=index_schema
                )
        finally:
            if out is not None:
                out.close()

    index_schema = pa.schema(
        [("id", {"bigint": pa.int64(), "string": pa.string()}[written]), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_type", pa.string())]
    )
    files, root = open_folder(folder)
    files.create_dir(root, recursive=True)
    index, _ = stored(rows.mapInArrow(archive, f"id {written}, file string, offset bigint, length bigint, record_type string"), "warc-index")
    return index.withColumn("id", F.col("id").cast(kind))


def read(spark: SparkSession, folder: str, index: DataFrame, least_files: int = 1) -> DataFrame:
    """Records of the files that the index names: record_id, url, payload_digest, payload_bytes, record_type, refers_to, payload.

    ``payload`` is null for revisits. A file is read frame by frame with the dictionary in its leading frame.
    """

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = open_folder(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with files.open_input_stream(f"{root}/{name}", compression=None) as source:
                    rows, held = [], 0
                    for data in frames(source):
                        fields, http, payload = parse(data)
                        revisit = fields["WARC-Type"] == "revisit"
                        rows.append(
                            {
                                "record_id": fields["WARC-Record-ID"],
                                "url": fields.get("WARC-Target-URI"),
                                "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
                                "payload_bytes": int(http["Content-Length"]),
                                "record_type": fields["WARC-Type"],
                                "refers_to": fields.get("WARC-Refers-To"),
                                "payload": None if revisit else payload,
                            }
                        )
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=record_schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=record_schema)

    record_schema = pa.schema(
        [(n, pa.string()) for n in ("record_id", "url", "payload_digest")]
        + [("payload_bytes", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
    )
    names = index.select("file").distinct().repartition(max(least_files, 2 * spark.sparkContext.defaultParallelism), "file")
    return names.mapInArrow(
        records,
        "record_id string, url string, payload_digest string, payload_bytes bigint, record_type string, refers_to string, payload binary",
    )


def frames(source) -> Iterator[bytes]:
    """The decompressed frames of one archive, with its leading dictionary if there is one."""
    head = source.read(8)
    dictionary, rest = None, head
    if len(head) == 8 and struct.unpack("<II", head)[0] == DICTIONARY_FRAME:
        dictionary, rest = zstandard.ZstdCompressionDict(source.read(struct.unpack("<II", head)[1])), b""
    reader = zstandard.ZstdDecompressor(dict_data=dictionary)
    current, parts = reader.decompressobj(), []
    while True:
        block = rest or source.read(1 << 20)
        rest = b""
        if not block:
            return
        while block:
            parts.append(current.decompress(block))
            block = b""
            if current.eof:
                block = current.unused_data
                yield b"".join(parts)
                current, parts = reader.decompressobj(), []


def read_one(folder: str, file: str, offset: int, length: int, dictionary: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its place in the index."""
    files, root = open_folder(folder)
    with files.open_input_file(f"{root}/{file}") as source:
        frame = source.read_at(length, offset)
    shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return parse(zstandard.ZstdDecompressor(dict_data=shared).decompress(frame))


def archive_pages(pages: DataFrame, least: int = 0, id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Write ``pages`` to a new folder of the shared one and read the records back from the files."""
    folder = scratch_path(pages.sparkSession, "warc")
    return read(pages.sparkSession, folder, write(pages, folder, least, id, url, html))
