"""WARC archives with a zstd dictionary of their own.

A task gathers its pages' records until they hold ``archive_bytes``, trains a dictionary on pieces of all of them, and writes
one archive: a skippable frame with the dictionary, then every record as a frame of its own, so that a reader can start at
any record once it has the dictionary. Of equal payloads one page's record is a response; the others are revisit records,
which repeat its HTTP header and digest and name it.

Spark writes the files by its text writer, one archive a file, so that a retried task leaves no half archive and any store
that Spark reaches will do. That writer ends a file with its separator, which here is an empty skippable frame.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import look_up, materialize, read_table, shared_dir

ARCHIVE_BYTES = 64 << 20
#: Bytes of records that a dictionary is trained on, dealt over all of an archive's records, and the dictionary's greatest size.
SAMPLE_BYTES, DICTIONARY_BYTES, LEVEL = 2 << 20, 64 << 10, 3
#: Equal payloads of so many bytes or more are archived once.
LEAST_BYTES = 0
# Fixed values of the zstd and WARC formats.
DICTIONARY_FRAME, EMPTY_FRAME = b"\x5d\x2a\x4d\x18", b"\x50\x2a\x4d\x18\0\0\0\0"
DICTIONARY_MAGIC = b"\x37\xa4\x30\xec"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The capture time of pages whose table names none.
DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, digest: str, kind: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = DATE) -> bytes:
    """One WARC record. The HTTP header's Content-Length is the payload's in a revisit too."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    uri = "".join(c if "!" <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or f"urn:page:{page_id}")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, "revisit" if revisit else "response")),
        ("WARC-Date", date),
        ("WARC-Target-URI", uri),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
    ]
    if page_id is not None:
        fields.append(("Page-ID", str(page_id)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest, "response")), ("Refers-To-Page-ID", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def trained(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from pieces of all the records; none where they are too few or too small to train on."""
    size = max(64, SAMPLE_BYTES // max(1, len(records)))
    pieces = []
    for k, r in enumerate(records):  # heads and bodies by turns, for a record's head holds what all have in common
        at = k * 7919 % max(1, len(r) - size) if k % 2 else 0
        pieces.append(r[at : at + size])
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8)
    except zstandard.ZstdError:
        return None


def archive(records: list[bytes], level: int = LEVEL) -> bytes:
    """The bytes of an archive of these records."""
    made = trained(records)
    compressor = zstandard.ZstdCompressor(level=level, dict_data=made, write_checksum=True)
    head = b""
    if made is not None:
        made.precompute_compress(level=level)
        head = DICTIONARY_FRAME + len(made).to_bytes(4, "little") + made.as_bytes()
    return head + b"".join(map(compressor.compress, records))


def _frame_end(data: bytes, at: int) -> int:
    """Where the frame that begins at ``at`` ends: behind its header, its blocks and its checksum."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)  # a repeated byte is stored once
        if block & 1:
            return at + 4 * (flags >> 2 & 1)


def frames(data: bytes) -> Iterator[bytes]:
    """The records of an archive, each as it is decompressed."""
    at, dictionary = 0, None
    while at < len(data):
        if data[at + 1 : at + 4] == EMPTY_FRAME[1:4] and data[at] >> 4 == 5:
            end = at + 8 + int.from_bytes(data[at + 4 : at + 8], "little")
            if data[at : at + 4] == DICTIONARY_FRAME:
                body = data[at + 8 : end]
                if body[:4] != DICTIONARY_MAGIC:  # the dictionary may be compressed itself
                    body = zstandard.ZstdDecompressor().decompress(body, max_output_size=1 << 27)
                dictionary = zstandard.ZstdCompressionDict(body)
        else:
            end = _frame_end(data, at)
            yield zstandard.ZstdDecompressor(dict_data=dictionary).decompress(data[at:end])
        at = end


def parsed(whole: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields and its block."""
    head, _, rest = whole.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if not lines[0].startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, rest[:n]


def decided(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(page_id, url, payload, refers_to, revisit) of every row of ``pages``.

    Of equal payloads of ``least_bytes`` or more the smallest page_id's is archived, null ids last; the others refer to it.
    Groupings shuffle digests alone; a payload moves at most once, and those of copies so many that their digest is hot do
    not move at all.
    """
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].cast("string").alias("url"), F.coalesce(pages["html"].cast("string"), F.lit("")).cast("binary").alias("payload"))
    long_enough = F.octet_length("payload") >= least_bytes
    rows = rows.withColumn("digest", F.when(long_enough, F.sha1("payload")))
    copies = rows.where("digest is not null").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("weight")).where("weight > 1")
    found = look_up(rows, materialize(copies, "copies"), ["digest"], "weight", pages.count())
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return found.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(pages: DataFrame, path: str, archive_bytes: int = ARCHIVE_BYTES, least_bytes: int = LEAST_BYTES) -> None:
    """The archives of all rows (page_id, url, html) of ``pages``, as files below ``path``.

    Null html is an empty payload; a null or empty url becomes ``urn:page:`` and the id; characters that a URI cannot
    hold are percent-encoded. Rows that repeat a page_id and a payload get the same decision, each a record. An archive holds
    whole records, so a page larger than ``archive_bytes`` makes one alone; one whose records are too few to train on has no
    dictionary. An empty table gives no archive. Other columns are ignored.
    """

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                held.append(record(*(x.as_py() for x in row)))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([archive(held)], pa.binary())], names=["value"])

    made = decided(pages, least_bytes).mapInArrow(archives, "value binary")
    made.select(F.col("value").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME.decode("ascii")).option("maxRecordsPerFile", 1).option("compression", "none").text(path)


RECORD = "page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``, with the ``payload`` of responses if asked for.

    A response's bytes and digest are taken from its payload and must agree with its header, else the read fails.
    """
    schema = RECORD + ", payload binary" * payloads
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], names=[f[0] for f in fields])

        for batch in batches:
            for content in batch.column(0):
                out, size = [], 0
                for whole in frames(content.as_py()):
                    out.append(_row(*parsed(whole))[: len(fields)])
                    size += len(whole)
                    if size >= 16 << 20:
                        yield sent(out)
                        out, size = [], 0
                if out:
                    yield sent(out)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, schema)


def _row(fields: dict[str, str], block: bytes) -> tuple:
    number = lambda name: int(fields[name]) if name in fields else None
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response":
        found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if (len(payload), found) != (size, digest):
            raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not agree with its header")
    else:
        payload = None
    return number("Page-ID"), fields["WARC-Type"], fields["WARC-Target-URI"], size, digest, number("Refers-To-Page-ID"), payload


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back from them."""
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(read_table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH t AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, min(page_id) AS first FROM t GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(h, 5 * (i // 4) + 1, 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM t JOIN g USING (h)
"""
