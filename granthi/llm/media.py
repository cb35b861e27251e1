"""Telephony audio: mu-law and A-law expansion by table, IMA ADPCM decoding across blocks, resampled PCM.

``store`` wraps 8-bit samples in a RIFF/WAVE container (format 7, mu-law, 8 kHz), ``read_back`` takes
them out of it, ``decode`` turns a coded payload into 16-bit PCM and ``resample`` doubles its rate. ``media_table``
has both as columns, the coded call and the resampled PCM, each a file; ``media_digests`` reads them back.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import read_table

UNIT = 576
BLOCK = 64  # bytes of an ADPCM block: a header of four, then two samples in each byte
RATE = 8000
CHUNK = 1 << 21


def _mu_law() -> np.ndarray:
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def _a_law() -> np.ndarray:
    code = np.arange(256, dtype=np.int32) ^ 0x55
    step, size = (code >> 4) & 7, (code & 0x0F) << 4
    size = np.where(step == 0, size + 8, (size + 0x108) << np.maximum(step - 1, 0))
    return np.where(code & 0x80, size, -size).astype(np.int16)


MU_LAW, A_LAW = _mu_law(), _a_law()
# The step sizes and index changes of IMA ADPCM.
STEPS = np.array(
    [
        7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107,
        118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963,
        1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894,
        6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794,
        32767,
    ],
    dtype=np.int32,
)
SHIFTS = np.array([-1, -1, -1, -1, 2, 4, 6, 8] * 2, dtype=np.int32)
_CODES = np.arange(16, dtype=np.int32)
#: By step index and code: the change of the sample, and the next step index.
CHANGES = np.where(
    _CODES & 8, -1, 1
) * ((STEPS[:, None] >> 3) + (STEPS[:, None] >> 2) * (_CODES & 1) + (STEPS[:, None] >> 1) * (_CODES >> 1 & 1) + STEPS[:, None] * (_CODES >> 2 & 1))
CHANGES = CHANGES.astype(np.int32).ravel()
NEXT = np.clip(np.arange(89)[:, None] + SHIFTS, 0, 88).astype(np.int32).ravel()


def decode_adpcm(payload: np.ndarray) -> np.ndarray:
    """Blocks of BLOCK bytes to an array of blocks by samples; all blocks advance together, a sample at a time.

    A header's step index above 88 counts as 88. The payload's length must be a multiple of BLOCK.
    """
    blocks = payload.reshape(-1, BLOCK)
    codes = np.empty((2 * (BLOCK - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((1 + len(codes), len(blocks)), np.int16)
    value = (blocks[:, 0].astype(np.uint16) | blocks[:, 1].astype(np.uint16) << 8).view(np.int16).astype(np.int32)
    at = np.minimum(blocks[:, 2], 88).astype(np.int32)
    out[0] = value
    for k, code in enumerate(codes):
        cell = (at << 4) + code
        value += CHANGES[cell]
        np.clip(value, -32768, 32767, out=value)
        at = NEXT[cell]
        out[k + 1] = value
    return out.T


def decode(payload: bytes | np.ndarray, codec: str) -> np.ndarray:
    """16-bit PCM of a payload in ``mulaw``, ``alaw`` or ``adpcm``."""
    codes = np.frombuffer(payload, np.uint8) if isinstance(payload, (bytes, bytearray, memoryview)) else payload
    return decode_adpcm(codes).ravel() if codec == "adpcm" else (MU_LAW if codec == "mulaw" else A_LAW)[codes]


def resample(pcm: np.ndarray) -> np.ndarray:
    """Twice the rate: every sample, then the floor of the mean of it and the next one (the last: itself)."""
    out = np.empty(2 * len(pcm), np.int16)
    out[0::2] = pcm
    out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
    out[-1:] = pcm[-1:]
    return out


def wave(samples: bytes, fmt: int, rate: int, width: int) -> bytes:
    head = struct.pack("<HHIIHHH", fmt, 1, rate, rate * width, width, 8 * width, 0)
    fact = struct.pack("<I", len(samples) // width)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<I", 4) + fact
    body += b"data" + struct.pack("<I", len(samples)) + samples + b"\0" * (len(samples) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def store(text: str | None) -> bytes:
    """The text's UTF-8 bytes, padded by 255 to a positive multiple of UNIT, as a mu-law file."""
    raw = (text or "").encode()
    return wave(raw + b"\xff" * (-len(raw) % UNIT or (0 if raw else UNIT)), 7, RATE, 1)


def read_back(media: bytes) -> bytes:
    """The samples of a stored file."""
    at = 12
    while media[at : at + 4] != b"data":
        at += 8 + struct.unpack_from("<I", media, at + 4)[0]
    return media[at + 8 : at + 8 + struct.unpack_from("<I", media, at + 4)[0]]


def pcm_file(media: bytes) -> bytes:
    """The stored call expanded and resampled to 16 kHz, as a PCM file."""
    return wave(resample(decode(read_back(media), "mulaw")).tobytes(), 1, 2 * RATE, 2)


def features(payloads: list[bytes], pcm: list[bytes]) -> list[str]:
    """For each payload: loudness as mu-law and as A-law, mean and peak as ADPCM; and its stored PCM's loudness and checksum."""
    joined = np.frombuffer(b"".join(payloads), np.uint8)
    ends = np.cumsum([len(p) for p in payloads])
    starts = ends - [len(p) for p in payloads]
    mu = MU_LAW[joined]
    loud = [np.add.reduceat(np.abs(x.astype(np.int32)), starts, dtype=np.int64) for x in (mu, A_LAW[joined])]
    adpcm = decode_adpcm(joined)
    block = starts // BLOCK
    total = np.add.reduceat(adpcm.sum(axis=1, dtype=np.int64), block)
    peak = np.maximum.reduceat(np.abs(adpcm.astype(np.int32)).max(axis=1), block)
    samples = np.frombuffer(b"".join(pcm), "<i2").astype(np.int32)
    wide = np.add.reduceat(np.abs(samples), 2 * starts, dtype=np.int64)
    return [f"mulaw={loud[0][i]};alaw={loud[1][i]};adpcm={total[i]},{peak[i]};pcm16k={wide[i]},{zlib.crc32(pcm[i]):08x}" for i in range(len(payloads))]


MEDIA = "doc_id long, n_bytes long, media binary, pcm binary"
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows, strict=True), fields, strict=True)], names=[f[0] for f in fields])


def _stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            text = text.as_py() or ""
            media = store(text)
            rows.append((doc_id.as_py(), len(text.encode()), media, pcm_file(media)))
            size += len(media)
            if size >= CHUNK:
                yield _batch(rows, MEDIA)
                rows, size = [], 0
        if rows:
            yield _batch(rows, MEDIA)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def emit(rows: list[tuple], payloads: list[bytes], pcm: list[bytes]) -> pa.RecordBatch:
        return _batch([(*r, f) for r, f in zip(rows, features(payloads, pcm), strict=True)], SCHEMA)

    for batch in batches:
        rows, payloads, pcm, size = [], [], [], 0
        for doc_id, n_bytes, media, wide in zip(*(batch.column(c) for c in ("doc_id", "n_bytes", "media", "pcm")), strict=True):
            media = media.as_py()
            payload = read_back(media)
            rows.append((doc_id.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest()))
            payloads.append(payload)
            pcm.append(read_back(wide.as_py()))
            size += len(payload)
            if size >= CHUNK:
                yield emit(rows, payloads, pcm)
                rows, payloads, pcm, size = [], [], [], 0
        if rows:
            yield emit(rows, payloads, pcm)


def media_table(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, media (the text's bytes as a mu-law call) and pcm (the same call, expanded and resampled to 16 kHz).

    Null texts are empty: one unit of padding. Equal texts give equal files, repeated rows repeat. An empty table
    gives an empty result; columns other than doc_id and text are ignored.
    """
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_stored, MEDIA)


def write_media(docs: DataFrame, path: str) -> DataFrame:
    """The media table, written as Parquet (zstd) below ``path`` and read back."""
    media_table(docs).write.option("compression", "zstd").mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(MEDIA).parquet(path)


def media_digests(media: DataFrame) -> DataFrame:
    """One row per row of a media table: digests of the stored call, and features of what is read back from both files."""
    return media.mapInArrow(_digests, SCHEMA)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(media_table(read_table(spark, sf_dir, "documents")))
