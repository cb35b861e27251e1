"""Byte-level BPE through a sentencepiece model made from a rank file.

The vocabulary becomes a sentencepiece BPE model: every token's bytes are mapped to one character
each, its score is its negative rank, and normalisation is the identity. Pre-tokens (matches of the
pattern) are encoded one by one; a pre-token that is a token is that token, as in tiktoken.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, read_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
#: Distinct pre-tokens that a Python worker remembers; then it starts anew.
REMEMBERED = 400_000


def byte_chars() -> list[str]:
    """A printable character for each byte: itself where it is one, else one from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def latin_pattern(pattern: str) -> str:
    """``pattern`` for the standard module, with its classes written out up to U+024F: the same matches, found faster."""
    low = "".join(map(chr, range(0x250)))
    letters, numbers, space = ("".join(map(re.escape, regex.findall(c, low))) for c in (r"\p{L}", r"\p{N}", r"\s"))
    pattern = re.sub(r"\[\^([^]]*)\]", lambda m: "[^" + m[1].replace(r"\p{L}", letters).replace(r"\p{N}", numbers).replace(r"\s", space) + "]", pattern)
    return pattern.replace(r"\p{L}", f"[{letters}]").replace(r"\p{N}", f"[{numbers}]").replace(r"\S", f"[^{space}]").replace(r"\s", f"[{space}]")


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def sentencepiece_model(tokens: dict[bytes, int]) -> bytes:
    """The serialised model. Piece 0 is the unknown one; the token of the k-th smallest rank is piece k + 1."""
    chars = byte_chars()
    pieces = [_field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2)]
    for token, rank in sorted(tokens.items(), key=lambda x: x[1]):
        pieces.append(_field(1, "".join(chars[b] for b in token).encode()) + _field(2, float(-rank)) + _field(3, 1))
    trainer = _field(3, 2) + _field(4, len(pieces)) + _field(40, 0) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, normalizer)


class ByteBPE:
    """Encoder and decoder over a rank file; any text, the empty one included, decodes to its own bytes."""

    def __init__(self, path: str = RANKS, pattern: str = public_tokenizers.PATTERN):
        with open(path, "rb") as f:
            self.tokens = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.by_id = {str(rank): token for token, rank in self.tokens.items()}
        self.ranks = [-1, *sorted(self.tokens.values())]
        self.model = sentencepiece.SentencePieceProcessor(model_proto=sentencepiece_model(self.tokens))
        self.find = regex.compile(pattern).findall
        self.find_latin = re.compile(latin_pattern(pattern)).findall
        self.beyond = re.compile("[^\0-\u024f]").search
        self.table = dict(enumerate(byte_chars()))
        self.known: dict[str, str] = {}

    def learn(self, pretokens: set[str]) -> None:
        """Remember the ids of pre-tokens, as decimal numbers joined by spaces."""
        mapped = [p.encode().decode("latin-1").translate(self.table) for p in pretokens]
        ranks = self.ranks
        for p, ids in zip(pretokens, self.model.encode(mapped, num_threads=1) if mapped else [], strict=True):
            own = self.tokens.get(p.encode())
            self.known[p] = " ".join([str(ranks[i]) for i in ids]) if own is None else str(own)

    def encode_many(self, texts: list[str]) -> list[str]:
        """Each text's ids, joined by spaces. The library is called once for all new pre-tokens."""
        found = [(self.find_latin if self.beyond(t) is None else self.find)(t) for t in texts]
        new = set().union(*found).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {}
            new = set().union(*found)
        self.learn(new)
        at = self.known.__getitem__
        return [" ".join(map(at, x)) for x in found]

    def encode(self, text: str) -> str:
        return self.encode_many([text])[0]

    def decode(self, ids: str) -> bytes:
        return b"".join(map(self.by_id.__getitem__, ids.split(" "))) if ids else b""


@lru_cache(2)
def encoder(path: str) -> ByteBPE:
    return ByteBPE(path)


SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def bpe_digests(docs: DataFrame, path: str = RANKS) -> DataFrame:
    """One row per row of ``docs``: token count and digests of the ids and of the decoded bytes.

    Null texts are empty: no tokens, digests of the empty string. Repeated rows repeat; an empty
    table gives an empty result; columns other than doc_id and text are ignored.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in batches:
            out = [[], [], []]
            for texts in chunks(batch.column(1)):
                for ids in own.encode_many(texts):
                    out[0].append(ids.count(" ") + 1 if ids else 0)
                    out[1].append(hashlib.sha256(ids.encode()).hexdigest())
                    out[2].append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, SCHEMA)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(read_table(spark, sf_dir, "documents"))
