"""Corpus counts of 64-bit keys, brought back to the texts that they come from.

Texts are packed once into blocks of bounded size. Every block sends each distinct key that it holds
once, cut by key ranges; whoever gets a range adds up what all have sent and answers each with the totals
of its own keys. So a word or passage that stands in every text costs one key for each block, and no key is
hot. A sender cuts its keys into at most ``FAN`` ranges. Where that leaves ranges too large for one task, the
exchange goes in steps: what a group of senders sent for one range is added up to a cell of about a block's
size, which sends its keys on as a block does, in ranges within its own. So the number of requests grows in
proportion to the input, by a step for each power of ``FAN``, and every group has a bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Bytes of text in a block. A longer text has a block to itself.
BLOCK_BYTES = 12_000_000
#: Keys that a shard gets at most, on average over the shards.
SHARD_KEYS = 2_000_000
#: Ranges that a sender cuts its keys into at most, and senders that a cell adds up, on average.
FAN = 256

BLOCKS = "block long, kind int, rows array<long>, doc_ids array<long>, flags array<int>, n_bytes long, offsets binary, texts binary"


def squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unsqueeze(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def put_numbers(x: np.ndarray) -> bytes:
    """Numbers byte by byte, so that their leading zeros compress away."""
    return squeeze(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def get_numbers(raw: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(unsqueeze(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def put_keys(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as differences."""
    return put_numbers(np.diff(keys, prepend=np.zeros(1, np.uint64)))


def get_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(get_numbers(raw, "u8"), dtype=np.uint64)


def pack_blocks(docs: DataFrame, kind: Column | None = None, flag: Column | None = None) -> DataFrame:
    """Blocks of rows (doc_id, text), written once so that their numbers and contents stay as they are.

    ``kind``: small integer; a block holds rows of one kind. ``flag``: an integer kept beside each id. ``rows`` numbers
    the rows, each with a number of its own, whatever the ids.
    """
    chosen = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "text",
        (F.lit(0) if kind is None else kind).cast("int").alias("kind"),
        (F.lit(0) if flag is None else flag).cast("int").alias("flag"),
    )
    most = BLOCK_BYTES

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 32
        number = TaskContext.get().partitionId() << 33
        held: dict[int, tuple[list, list, list, list]] = {}
        size: dict[int, int] = {}

        def emit(k: int) -> pa.RecordBatch:
            nonlocal at
            rows, ids, flags, texts = held.pop(k)
            offsets = np.cumsum([0, *map(len, texts)]).astype(np.int64)
            row = [at, k, rows, ids, flags, size.pop(k), squeeze(offsets.tobytes()), squeeze(b"".join(texts))]
            at += 1
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=["block", "kind", "rows", "doc_ids", "flags", "n_bytes", "offsets", "texts"])

        for batch in batches:
            for doc_id, text, k, f in zip(*(batch.column(i) for i in range(4)), strict=True):
                raw = (text.as_py() or "").encode()
                k = k.as_py()
                if k in held and size[k] + len(raw) > most:
                    yield emit(k)
                rows, ids, flags, texts = held.setdefault(k, ([], [], [], []))
                size[k] = size.get(k, 0) + len(raw)
                rows.append(number)
                number += 1
                ids.append(doc_id.as_py())
                flags.append(f.as_py())
                texts.append(raw)
        for k in [*held]:
            yield emit(k)

    return materialize(chosen.mapInArrow(rows, BLOCKS), "blocks")


def block_texts(row: dict) -> list[bytes]:
    """The texts of a block's row."""
    raw, offsets = unsqueeze(row["texts"]), np.frombuffer(unsqueeze(row["offsets"]), np.int64)
    return [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield {name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)}


REQUESTS = "shard long, source long, kind int, keys binary, counts binary"
REPLIES = "source long, shard long, reply binary, sums array<long>"
Found = list[tuple[np.ndarray, np.ndarray]]


def _requests(source: int, kind: int, found: Found, firsts: np.ndarray, fans: list[int], parents: list[int | None], step: int) -> list[tuple]:
    """A sender's requests: the keys of each class, all in range ``parents[c]`` of the step before (None: nothing), in ``fans[c]`` ranges."""
    out = []
    for (keys, counts), fan, parent, first in zip(found, fans, parents, firsts, strict=True):
        if parent is None or not len(keys):
            continue
        begin, whole = parent * fan, fan**step
        limits = np.array([(k << 64) // whole for k in range(begin + 1, begin + fan)], np.uint64)
        at = np.concatenate([[0], np.searchsorted(keys, limits), [len(keys)]])
        for k in np.flatnonzero(np.diff(at)):
            a, b = at[k], at[k + 1]
            out.append((int(first) + begin + int(k), source, kind, put_keys(keys[a:b]), put_numbers(counts[a:b].astype("<u8"))))
    return out


def _request_batch(out: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    columns = zip(*out, strict=True) if out else [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["shard", "source", "kind", "keys", "counts"])


def _merged(table: pa.Table) -> tuple[list[int], np.ndarray, np.ndarray, np.ndarray]:
    """Of requests: their sizes, their distinct keys, the place among these of every key, and every count."""
    keys = [get_keys(x.as_py()) for x in table.column("keys")]
    counts = np.concatenate([get_numbers(x.as_py(), "<u8") for x in table.column("counts")]).astype(np.int64)
    distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
    return [len(k) for k in keys], distinct, which, counts


class Exchange:
    """Asks for totals of the keys of ``senders`` and brings the answers back.

    ``find(sender's row)`` gives, for each class of keys, sorted distinct keys and their counts there. ``shards``:
    for each class, the number of final ranges wanted. ``reply(which, counts, kinds)`` sees one final range: ``which``
    numbers its distinct keys, an entry for each key asked, ``counts`` and ``kinds`` (0 to 3) run along with it. It
    returns arrays of an answer for each entry, of the types ``answer``, and numbers to be summed over all ranges.
    """

    def __init__(self, shards: list[int], reply: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[list[np.ndarray], list[int]]], answer: tuple[str, ...]):
        self.steps = next(k for k in range(1, 20) if max(shards) <= FAN**k)
        self.fans = [next(f for f in range(1, FAN + 1) if f**self.steps >= n) for n in shards]
        self.reply, self.answer = reply, answer

    def firsts(self, step: int) -> np.ndarray:
        """The number of each class's first range in a step, and the number of all ranges."""
        return np.concatenate([[0], np.cumsum([f**step for f in self.fans])])

    def asked(self, senders: DataFrame, find: Callable[[dict], Found]) -> DataFrame:
        firsts, fans = self.firsts(1)[:-1], self.fans

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for row in rows_of(batches):
                yield _request_batch(_requests(row["block"], row["kind"], find(row), firsts, fans, [0] * len(fans), 1))

        return senders.mapInArrow(rows, REQUESTS)

    def asked_after(self, senders: DataFrame, replies: list[DataFrame], find: Callable[[dict, list[dict[int, bytes]]], Found]) -> DataFrame:
        """The same where ``find`` needs the answers of earlier exchanges."""
        firsts, fans = self.firsts(1)[:-1], self.fans

        def use(row: dict, got: list[dict[int, bytes]]) -> pa.Table:
            return pa.Table.from_batches([_request_batch(_requests(row["block"], row["kind"], find(row, got), firsts, fans, [0] * len(fans), 1))])

        return with_answers(senders, replies, use, REQUESTS)

    def answers(self, asked: DataFrame, n_senders: int) -> tuple[DataFrame, dict[int, list[int]]]:
        """(block, shard, reply) for every request, and the sums of each class. ``asked``: of the senders, by ``asked``."""
        held = []
        for step in range(2, self.steps + 1):
            cells = asked.withColumn("cell", self._cell(step - 1, n_senders))
            held.append(materialize(cells, "requests"))
            asked = held[-1].groupBy("cell").applyInArrow(self._onwards(step), REQUESTS)
        replies = materialize(asked.groupBy("shard").applyInArrow(self._final(), REPLIES), "answers")
        last, sums = self.firsts(self.steps), {}
        size = replies.where("sums is not null").select("shard", "sums")
        classes = F.lit(0)
        for first in last[1:-1]:
            classes = classes + (F.col("shard") >= int(first)).cast("int")
        n = size.select(F.max(F.size("sums")).alias("n")).first()["n"] or 0
        if n:
            for r in size.groupBy(classes.alias("class")).agg(*(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(n))).collect():  # a row for each class
                sums[r["class"]] = [r[f"s{i}"] for i in range(n)]
        for back in reversed(held):
            found = replies.where("source is not null").select(F.col("source").alias("cell"), "shard", "reply")
            spread = back.groupBy("cell").cogroup(found.groupBy("cell")).applyInArrow(self._backwards(), REPLIES)
            nearer = materialize(spread, "answers")
            release(replies, back)
            replies = nearer
        return replies, sums

    def _cell(self, step: int, n_senders: int) -> Column:
        """The cell that takes a request on: one for each group of senders, kind and range."""
        groups = max(1, -(-n_senders // max(self.fans)))
        group = F.pmod(F.xxhash64("source"), F.lit(groups))
        if step > 1:  # senders are cells: the group of the group, so that a range's cells still join all its senders in the end
            group = F.pmod(F.xxhash64(F.expr(f"source div {4 * int(self.firsts(step - 1)[-1])}"), F.lit(step)), F.lit(max(1, -(-groups // max(self.fans) ** (step - 1)))))
        return (group * int(self.firsts(step)[-1]) + F.col("shard")) * 4 + F.col("kind")

    def _onwards(self, step: int):
        fans, before, firsts = self.fans, self.firsts(step - 1), self.firsts(step)[:-1]

        def group(key: tuple, table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            _, keys, which, counts = _merged(table)
            shard, kind = table.column("shard")[0].as_py(), table.column("kind")[0].as_py()
            own = int(np.searchsorted(before, shard, "right")) - 1
            found = [(keys, np.bincount(which, weights=counts).astype(np.int64)) if c == own else (keys[:0], counts[:0]) for c in range(len(fans))]
            parents = [shard - int(before[c]) if c == own else None for c in range(len(fans))]
            return pa.Table.from_batches([_request_batch(_requests(key[0].as_py(), kind, found, firsts, fans, parents, step))])

        return group

    def _final(self):
        reply, kinds_of = self.reply, self.answer

        def group(key: tuple, table: pa.Table) -> pa.Table:
            table = table.combine_chunks()
            sizes, _, which, counts = _merged(table)
            kinds = np.repeat(np.array(table.column("kind").to_pylist(), np.int8), sizes)
            found, sums = reply(which, counts, kinds)
            return _reply_table(table.column("source").to_pylist(), [key[0].as_py()] * len(sizes), sizes, [x.astype(t) for x, t in zip(found, kinds_of, strict=True)], [int(x) for x in sums])

        return group

    def _backwards(self):
        kinds_of = self.answer

        def group(left: pa.Table, right: pa.Table) -> pa.Table:
            left = left.combine_chunks()
            sizes, _, which, _ = _merged(left)
            order = np.argsort(right.column("shard").to_numpy(), kind="stable")
            parts = [unpack(right.column("reply")[int(k)].as_py(), kinds_of) for k in order]
            found = [np.concatenate(x)[which] for x in zip(*parts, strict=True)]
            return _reply_table(left.column("source").to_pylist(), left.column("shard").to_pylist(), sizes, found, None)

        return group


def _reply_table(sources: list[int], shards: list[int], sizes: list[int], found: list[np.ndarray], sums: list[int] | None) -> pa.Table:
    ends = np.cumsum(sizes)
    blobs = [squeeze(b"".join(squeeze_planes(x[a:b]) for x in found)) for a, b in zip(ends - sizes, ends, strict=True)]
    own = [] if sums is None else [sums]
    return pa.table(
        {
            "source": pa.array(sources + [None] * len(own), pa.int64()),
            "shard": pa.array(shards + shards[:1] * len(own), pa.int64()),
            "reply": pa.array(blobs + [None] * len(own), pa.binary()),
            "sums": pa.array([None] * len(blobs) + own, pa.list_(pa.int64())),
        }
    )


def squeeze_planes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes()


def unpack(reply: bytes, answer: tuple[str, ...]) -> list[np.ndarray]:
    """A reply's arrays, of the types ``answer``."""
    raw = unsqueeze(reply)
    widths = [np.dtype(t).itemsize for t in answer]
    n, at, out = len(raw) // sum(widths), 0, []
    for t, w in zip(answer, widths, strict=True):
        planes = np.frombuffer(raw, np.uint8, n * w, at).reshape(w, n)
        out.append(np.ascontiguousarray(planes.T).view(t).ravel())
        at += n * w
    return out


def with_answers(blocks: DataFrame, replies: list[DataFrame], use: Callable[[dict, list[dict[int, bytes]]], pa.Table], schema: str) -> DataFrame:
    """``use(block's row, replies by shard of each exchange)`` for each of ``blocks``. Replies to other blocks are left out."""
    mine, n = None, len(replies)
    for k, r in enumerate(replies):
        own = r.where("source is not null").select(F.col("source").alias("block"), F.lit(k).alias("which"), "shard", "reply")
        mine = own if mine is None else mine.unionByName(own)

    def group(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({f.name: pa.array([], f.type) for f in empty})
        got = [{} for _ in range(n)]
        for which, shard, reply in zip(*(right.column(c).to_pylist() for c in ("which", "shard", "reply")), strict=True):
            got[which][shard] = reply
        return use(left.to_pylist()[0], got)

    empty = arrow_schema(schema)
    return blocks.groupBy("block").cogroup(mine.groupBy("block")).applyInArrow(group, schema)


def arrow_schema(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "int": pa.int32(), "double": pa.float64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])
