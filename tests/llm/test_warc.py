import base64
import hashlib
import os

import pytest
import zstandard

from granthi.llm import warc

PAGES = [
    (None, None, None), (None, None, None), (5, "http://a/é b\n", "xxx"), (2, "http://a", "xxx"), (2, "http://a", "xxx"), (9, "", "é" * 10), (3, "http://z", ""), (1, "q", "y\r\n\r\nContent-Length: 7\r\n"),
    *((k, f"http://h/{k}", f"<html><head><title>page {k}</title></head><body>{'word ' * (k % 37)}{k % 11}</body></html>") for k in range(100, 400)),
    (7, "http://long", "<p>" + "long text " * 300_000),
]


def expected(pages, least=0):
    first = {}
    for page_id, _, html in pages:
        key = (html or "").encode()
        if len(key) >= least and page_id is not None:
            first[key] = min(first.get(key, page_id), page_id)
    out = []
    for page_id, _, html in pages:
        key = (html or "").encode()
        to = first.get(key) if first.get(key) != page_id else None
        out.append((page_id, len(key), base64.b32encode(hashlib.sha1(key).digest()).decode(), "response" if to is None else "revisit", to, key if to is None else None))
    return sorted(out, key=repr)


def read(spark, path):
    return sorted(map(tuple, warc.read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload").collect()), key=repr)


@pytest.mark.parametrize(("size", "least"), [(64 << 20, 0), (3000, 0), (20_000, 4)])
def test_round_trip(spark, tmp_path, size, least):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string").repartition(3)
    path = f"file://{tmp_path}/archives"
    warc.write_archives(df, path, size, least)
    assert read(spark, path) == expected(PAGES, least)
    names = [x for x in os.listdir(tmp_path / "archives") if x.startswith("part-")]
    assert len(names) > (3 if size < 64 << 20 else 0)
    seen = 0
    for name in names:  # by a plain decompressor that is told the dictionary alone
        data = (tmp_path / "archives" / name).read_bytes()
        dictionary = None
        if data[:4] == warc.DICTIONARY_FRAME:
            n = int.from_bytes(data[4:8], "little")
            dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + n])
            assert data[8:12] == warc.DICTIONARY_MAGIC
        whole = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(data, read_across_frames=True).read()
        seen += whole.count(b"WARC/1.1\r\n")
    assert seen == len(PAGES)


def test_dictionary_is_used_and_optional():
    records = [warc.record(k, f"http://h/{k}", f"<html><body>{k}{'a' * (k % 50)}</body></html>".encode(), None, False) for k in range(2000)]
    data = warc.archive(records)
    assert data[:4] == warc.DICTIONARY_FRAME and list(warc.frames(data)) == records
    assert len(data) - warc.DICTIONARY_BYTES < sum(len(zstandard.compress(r, 3)) for r in records) / 2
    one = warc.archive(records[:1])
    assert one[:4] != warc.DICTIONARY_FRAME and list(warc.frames(one + warc.EMPTY_FRAME)) == records[:1]
    assert list(warc.frames(b"")) == []


def test_records_name_each_other():
    fields, block = warc.parsed(warc.record(8, "http://b", b"same", 3, True))
    first, _ = warc.parsed(warc.record(3, "http://a", b"same", None, False))
    assert fields["WARC-Refers-To"] == first["WARC-Record-ID"] and block.endswith(b"Content-Length: 4\r\n\r\n")
    broken = warc.record(3, "http://a", b"same", None, False).replace(b"same", b"sbme")
    with pytest.raises(ValueError, match="does not agree"):
        warc._row(*warc.parsed(broken))
    with pytest.raises(ValueError, match="broken record"):
        warc.parsed(broken[:-1])


def test_hot_payload_and_empty_table(spark, tmp_path):
    rows = [(k, f"u{k}", "the same page" if k % 3 == 0 else f"page {k % 500}") for k in range(1, 6001)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write_archives(df, f"file://{tmp_path}/hot")
    assert read(spark, f"file://{tmp_path}/hot") == expected(rows)
    warc.write_archives(df.limit(0), f"file://{tmp_path}/none")
    assert read(spark, f"file://{tmp_path}/none") == []
