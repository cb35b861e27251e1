"""Best-fit packing by exact-complement hashing.

Documents become pieces of at most ``LIMIT`` tokens. Only the histogram of piece lengths (at most
``LIMIT`` numbers, however many rows) goes to the driver, where the plan is made on counts: for each
length, from the longest, the gap that it leaves is looked up among single lengths, then in an index of the
sums of two and one of three lengths, and combinations that fill it exactly are consumed as often as the
counts allow; what is left over is placed best fit, longest first, into the fullest sequence that has room.
The plan is a list of patterns with multiplicities. Every piece then finds its own place from its rank
among the pieces of its length: ranks come from counts for each chunk, so no length, however
common, is gathered into one task.
"""

from __future__ import annotations

import os
import re
import string
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import chunks, collect_garbage, materialize, read_table

LIMIT = 4096
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
#: Chunks whose numbers agree but for so many low bits form a band: those of 256 input partitions.
BAND = 40
#: Distinct words that a Python worker remembers; then it keeps those of the present chunk that it had met before.
REMEMBERED = 400_000


class WordEncoder:
    """The tokenizer's ids of whole texts, as little-endian 32-bit numbers.

    The tokenizer drops white space and splits at it, so the words between blanks, tabs and line ends are
    encoded one by one and remembered. ASCII capitals become small letters, and ASCII punctuation that ends a
    word of letters becomes a word of its own, as the tokenizer's pattern has it; both happen to whole lots of
    texts, but not to texts with combining marks, which the tokenizer composes before it lowers them. A text
    that holds one of the tokenizer's added tokens is encoded by the tokenizer in one piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.bare = Tokenizer.from_file(path)  # for lower-case ASCII letters, which the skipped steps leave alone
        self.bare.normalizer, self.bare.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.added = "|".join(re.escape(x.content) for x in self.tokenizer.get_added_tokens_decoder().values())
        self.known: dict[str, bytes] = {"": b""}
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for piece, i in self.tokenizer.get_vocab().items() if piece.endswith("</w>")]] = True

    def encode_plain(self, words: list[str], tokenizer) -> None:
        """Remember the ids of words of letters, many at a time: each ends with its first word-end token."""
        for k in range(0, len(words), 200):
            lot = words[k : k + 200]
            ids = np.array(tokenizer.encode_batch_fast([" ".join(lot)], add_special_tokens=False)[0].ids, "<u4")
            ends = (4 * (np.flatnonzero(self.is_end[ids]) + 1)).tolist()
            if len(ends) != len(lot):  # the tokenizer takes a letter for something else
                self.encode_odd(lot)
                continue
            self.known.update(zip(lot, map(ids.tobytes().__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))

    def encode_odd(self, words: list[str]) -> None:
        """Remember the ids of any words, one by one."""
        for k in range(0, len(words), 200):
            lot = words[k : k + 200]
            for x, e in zip(lot, self.tokenizer.encode_batch_fast(lot, add_special_tokens=False), strict=True):
                self.known[x] = np.array(e.ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        plain, letters, odd, parts = [], set(), set(), []
        for w in words:
            if w.isalpha():
                if w.isascii() and w.islower():
                    plain.append(w)
                elif not w.isascii():
                    letters.add(w)
                else:
                    odd.add(w)
                continue
            core = w.rstrip(string.punctuation)
            if not w.isascii() and core.isalpha() and max(core) < "\u0250" and core.lower().isalpha():
                letters.add(core)
                odd.add(w[len(core) :])
                parts.append((w, core, w[len(core) :]))
            else:
                odd.add(w)
        self.encode_plain(plain, self.bare)
        self.encode_plain([*letters.difference(self.known)], self.tokenizer)
        self.encode_odd([*odd.difference(self.known)])
        self.known.update([(w, self.known[core] + self.known[tail]) for w, core, tail in parts])

    def encode_many(self, texts: list[str]) -> list[bytes]:
        raw = pa.array(texts, pa.large_string())
        whole = pc.match_substring_regex(raw, self.added) if self.added else pa.array(np.zeros(len(texts), bool))
        marked = pc.match_substring_regex(raw, "[\u0300-\u036f]")
        low = pc.replace_substring_regex(pc.ascii_lower(raw), r"([a-z])([!-/:-@\[-`{-~]+)(\s|$)", r"\1 \2\3")
        split = pc.ascii_split_whitespace(pc.if_else(whole, "", pc.if_else(marked, raw, low)))
        coded = split.values.dictionary_encode()
        words = coded.dictionary.to_pylist()
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known = {"": b""} | {w: self.known[w] for w in words if w in self.known}  # words met again are the common ones
        self.learn(new)
        found = [*map(self.known.__getitem__, words)]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        which = coded.indices.to_numpy()
        n = size[which]
        ends = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(start[which] - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), "<u4")[at].tobytes()
        bounds = (4 * ends[split.offsets.to_numpy()]).tolist()
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.flatnonzero(whole.to_numpy(zero_copy_only=False)):
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, "<u4").tobytes()
        return out


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


class Complements:
    """Counts of lengths on hand, and indexes of the pairs and triples of lengths by their sum.

    A sum's pairs (of two lengths, the longer one first) and triples (a length and a pair of the remaining sum) are
    listed when the sum is first asked for, the longest lengths first. Counts only fall, so a
    combination that is used up never comes back, and each list is read once, whatever the number of questions.
    """

    def __init__(self, counts: dict[int, int], limit: int):
        self.have = [0] * (limit + 1)
        for length, n in counts.items():
            self.have[length] += n
        self.pairs: dict[int, array] = {}
        self.triples: dict[int, array] = {}

    def pair(self, total: int, spoken: int = 0) -> tuple[int, int] | None:
        """The first pair of this sum on hand; ``spoken``: a length whose count lacks one that is spoken for at present."""
        have, firsts = self.have, self.pairs.get(total)
        if firsts is None:  # in rising order: the last one is the pair's longest
            firsts = self.pairs[total] = array("I", (a for a in range((total + 1) // 2, total) if have[a] and have[total - a]))
        at = len(firsts) - 1
        while at >= 0:
            a = firsts[at]
            if have[a] and have[total - a] and (2 * a != total or have[a] > 1):
                return a, total - a
            if spoken not in (a, total - a):
                del firsts[at]
            at -= 1
        return None

    def triple(self, total: int) -> tuple[int, int, int] | None:
        """The first triple of this sum on hand."""
        have, firsts = self.have, self.triples.get(total)
        if firsts is None:
            firsts = self.triples[total] = array("I", (a for a in range(-(-total // 3), total - 1) if have[a]))
        while firsts:
            a = firsts[-1]
            if have[a]:
                have[a] -= 1
                two = self.pair(total - a, a)
                have[a] += 1
                if two:
                    return a, *two
            firsts.pop()
        return None


def plan(counts: dict[int, int], limit: int = LIMIT) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of a sequence's pieces, number of such sequences) that use up ``counts``."""
    hand = Complements(counts, limit)
    have = hand.have
    out: list[tuple[tuple[int, ...], int]] = []

    def take(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        n = min(have[x] // k for x, k in need.items())
        for x, k in need.items():
            have[x] -= n * k
        out.append((pattern, n))

    if have[limit]:
        take((limit,))
    leftover = np.zeros(limit + 1, np.int64)
    for length in range(limit - 1, 0, -1):
        gap = limit - length
        while have[length]:
            have[length] -= 1  # the piece whose gap is to be filled
            rest = (gap,) if have[gap] else hand.pair(gap) or hand.triple(gap)
            have[length] += 1
            if not rest:
                break
            take((length, *rest))
        leftover[length], have[length] = have[length], 0
    groups: dict[int, dict[tuple[int, ...], int]] = {}  # room left: pattern, number of sequences
    for length in range(limit - 1, 0, -1):
        n = int(leftover[length])
        while n:
            room = min((r for r in groups if r >= length), default=None)
            if room is None:
                pattern, most = (), n
                fit = limit // length
                if n >= fit:  # whole sequences of this length alone
                    groups.setdefault(limit - fit * length, {}).setdefault((length,) * fit, 0)
                    groups[limit - fit * length][(length,) * fit] += n // fit
                    n %= fit
                    continue
                room, most = limit, 1
            else:
                pattern, most = next(iter(groups[room].items()))
            m = min(n, most)
            if pattern:
                groups[room][pattern] -= m
                if not groups[room][pattern]:
                    del groups[room][pattern]
                    if not groups[room]:
                        del groups[room]
            rest = groups.setdefault(room - length, {})
            rest[(*pattern, length)] = rest.get((*pattern, length), 0) + m
            n -= m
    return [x for x in [*out, *((p, m) for rest in groups.values() for p, m in rest.items())] if x[1]]


PIECES = "chunk long, doc_id long, piece int, start long, length long, local_rank long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """The pieces of every row, each with its rank among its chunk's pieces of that length; ``keep_ids`` adds the ids."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = np.array([END_ID], "<u4").tobytes()
        at = TaskContext.get().partitionId() << 32
        for batch in batches:
            seen = np.zeros(limit + 1, np.int64)
            out, ids, row = [], [], 0
            for texts in chunks(batch.column(1), 3_000_000):
                for raw in own.encode_many(texts):
                    raw += end
                    doc_id = batch.column(0)[row].as_py()
                    row += 1
                    for piece, start in enumerate(range(0, len(raw) // 4, limit)):
                        part = raw[4 * start : 4 * (start + limit)]
                        n = len(part) // 4
                        out.append((at, doc_id, piece, start, n, int(seen[n]), zlib.crc32(part)))
                        if keep_ids:
                            ids.append(part)
                        seen[n] += 1
                pa.default_memory_pool().release_unused()  # else an idle worker keeps some 130 MB
            at += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.int64()] * 4]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True)]
            names = [x.split()[0] for x in PIECES.split(", ")]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.binary())] * keep_ids, names=names + ["ids"] * keep_ids)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, PIECES + ", ids binary" * keep_ids)


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, limit: int = LIMIT, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).

    Null texts are empty and have the end token alone. Texts longer than ``limit`` are cut into pieces of
    ``limit`` tokens, the last one shorter; no other is cut. Rows that repeat a doc_id are packed as rows of
    their own. Null doc_ids stay null. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    made = materialize(pieces(docs, tokenizer, limit, keep_ids), "pieces")
    counted = materialize(made.groupBy("chunk", "length").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``limit`` rows
    collect_garbage(spark)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}  # by length: first rank, sequence of it, offset, step
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, n in plan(histogram, limit):
        offset = 0
        for length in pattern:
            slots.setdefault(length, []).append((used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    # Ranks before each chunk: sums over groups of chunks first, so that no window holds a common length's every chunk.
    counted = counted.withColumn("band", F.shiftright("chunk", BAND))
    back = lambda *by: Window.partitionBy("length", *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    bands = counted.groupBy("length", "band").agg(F.sum("n").alias("n")).select("length", "band", F.coalesce(F.sum("n").over(back("band")), F.lit(0)).alias("below"))
    inside = counted.select("length", "band", "chunk", F.coalesce(F.sum("n").over(back("band", "chunk")), F.lit(0)).alias("inside"))
    before = inside.join(bands, ["length", "band"]).select("length", "chunk", (F.col("below") + F.col("inside")).alias("before"))
    ranked = made.join(before, ["chunk", "length"])
    table = spark.sparkContext.broadcast({k: np.array(v, np.int64).T for k, v in slots.items()})  # some 53,000 slots from 3 million to 3 billion pieces: the plan follows from ``limit`` counts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            sequence_id, offset = np.empty_like(rank), np.empty_like(rank)
            for n in np.unique(length):
                mine = length == n
                starts, sequences, offsets = table.value[int(n)]
                k = np.searchsorted(starts, rank[mine], "right") - 1
                sequence_id[mine] = sequences[k] + rank[mine] - starts[k]
                offset[mine] = offsets[k]
            kept = [c for c in batch.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence_id), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    ids = ", ids binary" * keep_ids
    chosen = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids, (F.col("before") + F.col("local_rank")).alias("rank"))
    return chosen.mapInArrow(place, f"doc_id long, piece int, start long, length long, ids_crc32 long{ids}, sequence_id long, offset long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"))
