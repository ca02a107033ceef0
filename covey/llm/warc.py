"""WARC archives with individually compressed records and an embedded Zstandard dictionary.

An archive (.warc.zst) is a skippable frame (magic 0x184D2A5D) that holds a dictionary, then one Zstandard frame for
each record, compressed with it.  Each archive's dictionary is built from the first records that go into it, at most
SAMPLE_BYTES of them; a reader needs nothing but the file.

Of rows with equal payloads of at least ``least_bytes`` bytes, that with the largest page_id is written as a response
and the others as revisits, which hold the HTTP header alone and name the response.  Between equal rows of the largest
page_id one is the response.  Null page_ids are smaller than all others.

Scale: payload digests are grouped narrow, with partial aggregation; payloads move once, packed, to meet the
decisions, in a join that AQE can split where one payload fills a third of all pages.  Each task streams its rows to
archives of at most ARCHIVE_BYTES; nothing is collected.  Rows of a task are sorted, so an attempt repeated after a
lost executor writes byte-identical files over those of the first, each renamed into place when whole.

Edge cases: a null html is an empty payload; control characters in a url are percent-encoded in the header; an empty
table gives no archive and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from covey.llm.common import Scratch, packed, unpack

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20
SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 64 << 10
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id, digest: str, kind: str, place: int = 0) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{kind}/{page_id}/{digest}/{place}')}>"


def header_value(text: str | None) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in text or "")


def record(page_id, url: str | None, payload: bytes, refers_to, revisit: bool, place: int = 0) -> bytes:
    """One WARC record; a revisit keeps the HTTP header, with the payload's length, and no payload."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, digest, kind, place)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {header_value(url)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"X-Page-ID: {page_id}")
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 'response')}", *([f"X-Refers-To-Page-ID: {refers_to}"] if refers_to is not None else [])]
    return "\r\n".join([*lines, "", ""]).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A trained dictionary; the records' own beginnings where there are too few to train on."""
    import zstandard

    if len(records) >= 64 and sum(map(len, records)) >= 8 * 4096:
        try:
            return zstandard.train_dictionary(min(size, max(4096, sum(map(len, records)) // 8)), records, k=256, d=8).as_bytes()
        except zstandard.ZstdError:  # too little that repeats
            pass
    return b"".join(r[:2048] for r in records)[: size // 4]


def archives(records: Iterable[bytes], most: int = ARCHIVE_BYTES) -> Iterator[tuple[bytes, int]]:
    """(bytes, records) of successive archives; holds one archive in memory."""
    import zstandard

    waiting: list[bytes] = []
    out, press, raw, count = io.BytesIO(), None, 0, 0

    def start() -> zstandard.ZstdCompressor:
        words = build_dictionary(waiting)
        out.write(struct.pack("<II", SKIPPABLE, len(words)) + words)
        return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(words), write_content_size=True)

    for r in records:
        raw, count = raw + len(r), count + 1
        if press is None:
            waiting.append(r)
            if raw < SAMPLE_BYTES:
                continue
            press = start()
            for w in waiting:
                out.write(press.compress(w))
            waiting = []
        else:
            out.write(press.compress(r))
        if raw >= most:
            yield out.getvalue(), count
            out, press, raw, count = io.BytesIO(), None, 0, 0
    if count:
        if press is None:
            press = start()
            for w in waiting:
                out.write(press.compress(w))
        yield out.getvalue(), count


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields by lower-case name, block) of each record."""
    import zstandard

    magic, size = struct.unpack("<II", data[:8])
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary frame")
    press = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size]))
    stream = io.BufferedReader(press.stream_reader(memoryview(data)[8 + size :], read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        block = stream.read(int(fields["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record ends early")
        yield fields, block


def decide(pages: DataFrame, scratch: Scratch, least_bytes: int) -> DataFrame:
    """``pages`` packed (page_id, url, html) with revisit and refers_to."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digest = F.sha1(payload)
    same = pages.select("page_id", digest.alias("digest"), F.octet_length(payload).alias("bytes")).where(F.col("bytes") >= least_bytes)
    same = same.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    same = same.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1")
    groups = scratch.table(same.select(F.col("digest").alias("_digest"), F.col("top.page_id").alias("top"), (F.col("top.n") > 1).alias("tied")), "payloads")
    rows = packed(pages.select(F.coalesce("html", F.lit("")).alias("html"), "page_id", "url", digest.alias("digest")), "html", "page_id", "url", "digest")
    rows = rows.join(groups, F.col("digest") == F.col("_digest"), "left")
    top = F.col("page_id").eqNullSafe(F.col("top"))
    plain = rows.where("_digest is null or not tied").withColumn("revisit", F.col("_digest").isNotNull() & ~top)
    if groups.where("tied").limit(1).count():
        # several rows of the largest page_id: numbered where they are written, one is picked from numbers alone
        rows = scratch.table(rows.where("tied").withColumn("row", F.monotonically_increasing_id()), "tied")
        first = rows.where(F.col("page_id").eqNullSafe(F.col("top"))).groupBy(F.col("digest").alias("_of")).agg(F.min(F.struct("url", "row"))["row"].alias("first"))
        rows = rows.join(scratch.table(first, "first"), F.col("digest") == F.col("_of"))
        plain = plain.unionByName(rows.withColumn("revisit", F.col("row") != F.col("first")).select(*plain.columns))
    return plain.select("page_id", "url", "html", "digest", "revisit", F.when(F.col("revisit"), F.col("top")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, scratch: Scratch, least_bytes: int = 0, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) to archives in ``folder``; returns (path, records, bytes) of each."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()

        def records() -> Iterator[bytes]:
            place = 0
            for batch in batches:
                for page_id, url, html, revisit, refers_to in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "revisit", "refers_to"))):
                    place += revisit
                    yield record(page_id, url, unpack([html])[0], refers_to, revisit, place if revisit else 0)

        for n, (data, count) in enumerate(archives(records(), most)):
            name = f"part-{part:06d}-{n:04d}.warc.zst"
            with system.open_output_stream(f"{root}/_{name}.{attempt}") as f:
                f.write(data)
            system.move(f"{root}/_{name}.{attempt}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [count], "bytes": [len(data)]})

    rows = decide(pages.select("page_id", "url", "html"), scratch, least_bytes).sortWithinPartitions("page_id", "digest", "url", "revisit")
    schema = StructType([StructField("path", StringType()), StructField("records", LongType()), StructField("bytes", LongType())])
    return scratch.table(rows.mapInArrow(write, schema), "archives")


def read_archives(spark: SparkSession, folder: str, id_type="bigint", payloads: bool = True) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload) of every record in ``folder``.

    payload_bytes and payload_digest are of the full payload: computed for responses and held against the header; for
    revisits, whose payload is null, as archived.  ``payloads`` False leaves the payloads themselves out.
    """
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                rows: list[tuple] = []
                held = 0
                for fields, block in read_archive(data.as_buffer().to_pybytes()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    stated = fields["warc-payload-digest"].removeprefix("sha1:")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    revisit = fields["warc-type"] == "revisit"
                    if not revisit and (len(payload) != size or base32_sha1(payload) != stated):
                        raise ValueError(f"a payload differs from its digest: {fields['warc-record-id']}")
                    rows.append((fields.get("x-page-id"), fields["warc-target-uri"], fields["warc-type"], fields.get("x-refers-to-page-id"), size, stated, payload if payloads and not revisit else None))
                    held += len(block)
                    if held >= 4 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    schema = StructType([*[StructField(n, LongType() if n == "payload_bytes" else StringType()) for n in names[:-1]], StructField("payload", BinaryType())])
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.warc.zst").load(folder).select("content")
    out = files.mapInArrow(read, schema)
    return out.withColumn("page_id", F.col("page_id").cast(id_type)).withColumn("refers_to", F.col("refers_to").cast(id_type))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    scratch = Scratch(spark, "warc")
    folder = scratch.path("archives")
    written = write_archives(pages, folder, scratch)
    if not written.limit(1).count():
        return spark.createDataFrame([], "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    out = read_archives(spark, folder, pages.schema["page_id"].dataType, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return scratch.finish(out, "warc-records")
