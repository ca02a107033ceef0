import base64
import hashlib
import struct

import zstandard

from covey.llm import warc
from covey.llm.common import Scratch


def test_archive_format(prose):
    records = [warc.record(k, f"http://x.org/{k}\r\n", (prose(80) * 3).encode(), None, False) for k in range(300)]
    data, count = next(warc.archives(iter(records)))
    magic, size = struct.unpack("<II", data[:8])
    assert magic == 0x184D2A5D and 0x184D2A50 <= magic <= 0x184D2A5F and count == 300
    words = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    press, rest = zstandard.ZstdDecompressor(dict_data=words), data[8 + size :]
    for r in records:  # each record is a frame of its own
        one = press.decompressobj()
        assert one.decompress(rest) == r
        rest = one.unused_data
    assert rest == b"" and [b for _, b in warc.read_archive(data)] != []
    assert len(data) < sum(len(zstandard.compress(r)) for r in records)


def test_few_records_and_rolling():
    tiny = [warc.record(1, None, b"", None, False), warc.record(None, "u", b"\x00\r\n\r\nx", 4, True)]
    (data, n), = warc.archives(iter(tiny))
    fields = list(warc.read_archive(data))
    assert n == 2 and fields[0][0]["warc-type"] == "response" and fields[1][0]["x-refers-to-page-id"] == "4"
    few = list(warc.archives(iter([b"WARC" * 300_000] * 4), most=2 << 20))
    assert [n for _, n in few] == [2, 2]


def expected(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    best: dict = {}
    for p, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if p is None else p)
    out, used = [], set()
    for p, _, h in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        top = best[h or ""]
        first = p == top and (h or "") not in used
        if first:
            used.add(h or "")
        out.append((p, len((h or "").encode()), digest(h), "response" if first else "revisit", None if first else top))
    return sorted(out, key=str)


def test_round_trip(spark, tmp_path, prose):
    same = prose(200)
    rows = [(k, f"http://h.org/{k}", prose(30 + k)) for k in range(60)] + [(100 + k, None, same) for k in range(40)] + [(200, "u", None), (201, "u", ""), (202, "é\n", "é" * 5000), (150, "again", prose(5)), (139, "dup", same)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")
    scratch = Scratch(spark, "w")
    written = warc.write_archives(pages, f"file://{tmp_path}/a", scratch)
    assert written.agg({"records": "sum"}).first()[0] == len(rows)
    back = warc.read_archives(spark, f"file://{tmp_path}/a")
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in back.collect()), key=str)
    assert got == expected(rows)
    texts = {r["page_id"]: bytes(r["payload"]).decode() for r in back.where("record_type = 'response'").collect()}
    assert all(texts[k] == h for k, _, h in rows[:60])


def test_query_and_empty(spark, small):
    rows = [(r["page_id"], r["url"], r["html"]) for r in spark.read.parquet(f"{small}/pages.parquet").collect()]
    assert sorted(map(tuple, warc.op3_warc(spark, small).collect()), key=str) == expected(rows)
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.write_archives(none, "file:///tmp/covey-none", Scratch(spark, "w")).count() == 0
