"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Every feature is a slot of one table: words by their hash (all of a text's words, with weight by the
root of their frequency; words of one slot add up), structure statistics by bins, and the stated length by bins. A score is
``w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2]``, linear in the number of features. The
machine is trained on the driver from at most ``SAMPLE`` labelled rows, which arrive as feature lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, collect_garbage, crc32_mod, has_count, read_table
from .ngrams import SPACES, U, join_texts, mix, words

WORD_SLOTS = 1 << 16
BINS = 16
STATS = 15
SLOTS = WORD_SLOTS + (STATS + 1) * BINS
RANK = 8
#: The labelled rows that training reads at most, the first ones by a hash of their ids.
SAMPLE = 12_000
EPOCHS, BATCH, RATE, DECAY, SEED = 6, 64, 0.08, 2e-4, 7
FOLDS, HELD_OUT = 3, 1


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums between offsets; empty stretches sum to 0."""
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(np.float64)


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, key) with their counts, and the number for each owner."""
    order = np.lexsort((keys, owner))
    keys, owner = keys[order], owner[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return keys[at], owner[at], np.diff(np.append(at, len(keys))), np.bincount(owner[at], minlength=n)


def features(texts: list[str | None], stated: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(slots, values, offsets): every text's features, one text after another.

    ``stated``: the table's length column, -1 where it is null. The empty text has its bins alone.
    """
    n = len(texts)
    data, offsets = join_texts(texts)
    hashes, starts = words(data)
    at = np.searchsorted(starts, offsets)
    owner = np.repeat(np.arange(n), np.diff(at))
    size = np.maximum(np.diff(offsets) - 1, 1).astype(np.float64)
    upper, lower = (data >= 65) & (data <= 90), (data >= 97) & (data <= 122)
    digit, space, high = (data >= 48) & (data <= 57), SPACES[data], data >= 128
    mark = ~(upper | lower | digit | space | high)
    stop = (data == 46) | (data == 44)
    repeat = np.zeros(len(data), bool)
    repeat[1:] = (data[1:] == data[:-1]) & ~space[1:]
    kinds = [_sums(x, offsets) / size for x in (upper, digit, mark & ~stop, stop, space, high, repeat)]
    n_words = np.diff(at).astype(np.float64)
    word, who, count, distinct = _distinct(hashes, owner, n)
    pairs = mix(hashes[:-1] * U(3) + hashes[1:])[owner[:-1] == owner[1:]]
    pair_owner = owner[:-1][owner[:-1] == owner[1:]]
    _, _, _, distinct_pairs = _distinct(pairs, pair_owner, n)
    ends = np.flatnonzero(data == 10)
    total = np.concatenate([np.zeros(1, U), np.cumsum(mix(hashes + U(1)), dtype=U)])
    word_at = np.searchsorted(starts, np.concatenate([[0], ends + 1]))
    lines = total[word_at[1:]] - total[word_at[:-1]]
    line_owner = np.searchsorted(offsets, ends, "right") - 1
    filled = lines != 0
    _, _, _, distinct_lines = _distinct(lines[filled], line_owner[filled], n)
    n_lines = np.bincount(line_owner[filled], minlength=n).astype(np.float64)
    first = np.concatenate([data[starts], [0]])[: len(starts)] if len(starts) else np.empty(0, np.uint8)
    capital = np.bincount(owner[(first >= 65) & (first <= 90)], minlength=n) / np.maximum(n_words, 1)
    most = np.zeros(n)
    np.maximum.at(most, who, count)
    ratios = [
        distinct / np.maximum(n_words, 1),
        distinct_pairs / np.maximum(n_words - 1, 1),
        distinct_lines / np.maximum(n_lines, 1),
        most / np.maximum(n_words, 1),
        capital,
    ]
    logs = [np.log2(1 + n_words), np.log2(1 + n_lines), 2 * np.log2(1 + size / np.maximum(n_words, 1))]
    bins = [(np.sqrt(x) * BINS).astype(np.int64).clip(0, BINS - 1) for x in (*kinds, *ratios)]
    bins += [x.astype(np.int64).clip(0, BINS - 1) for x in logs]
    bins.append(np.where(stated < 0, BINS - 1, np.log2(1 + np.maximum(stated, 0)).astype(np.int64).clip(0, BINS - 2)))
    fixed = np.stack([WORD_SLOTS + k * BINS + b for k, b in enumerate(bins)], axis=1)
    value = np.sqrt(count) / np.sqrt(np.maximum(n_words, 1))[who]
    slot = (word >> U(48)).astype(np.int64)  # the slot is the hash's highest bits: words of one slot are neighbours
    new = np.ones(len(slot), bool)
    new[1:] = (slot[1:] != slot[:-1]) | (who[1:] != who[:-1])
    at = np.flatnonzero(new)
    value = np.add.reduceat(value, at) if len(at) else value
    slots = np.concatenate([slot[at], fixed.ravel()])
    values = np.concatenate([value, np.full(fixed.size, 0.5)])
    owners = np.concatenate([who[at], np.repeat(np.arange(n), fixed.shape[1])])
    order = np.argsort(owners, kind="stable")
    return slots[order], values[order].astype(np.float32), np.concatenate([[0], np.cumsum(np.bincount(owners, minlength=n))])


class Machine:
    """The factorisation machine's parameters."""

    def __init__(self, slots: int = SLOTS, rank: int = RANK, seed: int = SEED):
        self.w0 = 0.0
        self.w = np.zeros(slots, np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (slots, rank)).astype(np.float32)

    def raw(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the logistic function, and the sums that they are made of; no text is without features."""
        vx = self.v[slots] * values[:, None]
        sums = np.add.reduceat(vx, offsets[:-1])
        squares = np.add.reduceat(vx * vx, offsets[:-1])
        return self.w0 + np.add.reduceat(self.w[slots] * values, offsets[:-1]) + 0.5 * (sums * sums - squares).sum(axis=1), sums

    def probability(self, slots: np.ndarray, values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(slots, values, offsets)[0].astype(np.float64)))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS) -> Machine:
        """Logistic loss by Adagrad over minibatches; the rows' order is fixed by the seed."""
        if not len(labels):
            self.v[:] = 0.0
            return self
        share = float(np.clip(labels.mean(), 0.02, 0.98))
        self.w0 = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_0 = np.full(len(self.w), 1e-3, np.float32), np.full(self.v.shape, 1e-3, np.float32), 1e-3
        rng = np.random.default_rng(SEED)
        for _ in range(epochs):
            order = rng.permutation(len(labels))
            for k in range(0, len(order), BATCH):
                lot = order[k : k + BATCH]
                slots = np.concatenate([rows[i][0] for i in lot])
                values = np.concatenate([rows[i][1] for i in lot]).astype(np.float32)
                lengths = np.array([len(rows[i][0]) for i in lot])
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                raw, sums = self.raw(slots, values, offsets)
                error = (1 / (1 + np.exp(-raw)) - labels[lot]).astype(np.float32)
                x = values[:, None]
                own = np.repeat(error, lengths)
                own_v = own[:, None] * x * (np.repeat(sums, lengths, axis=0) - self.v[slots] * x)
                used, which = np.unique(slots, return_inverse=True)
                g = np.bincount(which, weights=own * values).astype(np.float32) + DECAY * self.w[used]
                gv = np.stack([np.bincount(which, weights=own_v[:, f]) for f in range(own_v.shape[1])], axis=1).astype(np.float32) + DECAY * self.v[used]
                seen_w[used] += g * g
                seen_v[used] += gv * gv
                self.w[used] -= RATE * g / np.sqrt(seen_w[used])
                self.v[used] -= RATE * gv / np.sqrt(seen_v[used])
                g0 = float(error.sum())
                seen_0 += g0 * g0
                self.w0 -= RATE * g0 / seen_0**0.5
        return self


def _inputs(docs: DataFrame) -> list:
    stated = F.col("n_chars").cast("long") if has_count(docs) else F.lit(None).cast("long")
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.coalesce(stated, F.lit(-1)).alias("stated")]


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """A machine trained on at most SAMPLE labelled rows whose ids are not in the held-out fold.

    Rows with a null label are left out; a doc_id labelled more than once counts with its greatest label. Of rows
    that share a labelled doc_id one is learned from: the one whose features come first in byte order.
    """
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("quality").alias("label"))
    marks = marks.where(crc32_mod(F.col("id"), FOLDS) != HELD_OUT).orderBy(F.xxhash64("id"), "id").limit(SAMPLE)
    chosen = docs.select(*_inputs(docs)).join(F.broadcast(marks), F.col("doc_id") == F.col("id"))  # SAMPLE rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(1)):
                part = batch.slice(start, len(texts))
                start += len(texts)
                slots, values, offsets = features(texts, part.column(2).to_numpy())
                a, b = [], []
                for i, j in zip(offsets[:-1], offsets[1:], strict=True):
                    a.append(slots[i:j].astype("<i4").tobytes())
                    b.append(values[i:j].astype("<f2").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(3), pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "label", "slots", "values"])

    got = chosen.select("doc_id", "text", "stated", F.col("label").cast("int").alias("label")).mapInArrow(rows, "doc_id long, label int, slots binary, values binary")
    got = got.groupBy("doc_id").agg(F.min(F.struct("slots", "values", "label")).alias("x")).select("doc_id", "x.*")
    sample = sorted(got.collect(), key=lambda r: (r["doc_id"], bytes(r["slots"])))  # SAMPLE rows at most, each of SLOTS features at most
    x = [(np.frombuffer(r["slots"], "<i4"), np.frombuffer(r["values"], "<f2").astype(np.float32)) for r in sample]
    y = np.array([r["label"] for r in sample], np.float32)
    del sample
    collect_garbage(docs.sparkSession)
    return Machine().fit(x, y)


SCHEMA = "doc_id long, score double"


def scores(docs: DataFrame, machine: Machine) -> DataFrame:
    """(doc_id, score) of every row, from its whole text."""
    held = docs.sparkSession.sparkContext.broadcast(machine)  # SLOTS by RANK numbers, whatever the input

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(1), 500_000):
                part = batch.slice(start, len(texts))
                start += len(texts)
                p = held.value.probability(*features(texts, part.column(2).to_numpy()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p)], names=["doc_id", "score"])

    return docs.select(*_inputs(docs)).mapInArrow(rows, SCHEMA)


def accepted(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is at least 0.5. Rows are judged where they are read: nothing is shuffled."""
    held = docs.sparkSession.sparkContext.broadcast(machine)
    text, stated = docs.columns.index("text"), docs.columns.index("n_chars") if has_count(docs) else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for texts in chunks(batch.column(text), 500_000):
                part = batch.slice(start, len(texts))
                start += len(texts)
                lengths = np.full(len(texts), -1) if stated is None else part.column(stated).cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
                yield part.filter(pa.array(held.value.probability(*features(texts, lengths)) >= 0.5))

    return docs.mapInArrow(rows, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted.

    Null texts are empty, and are scored. Without labels every score is 0.5. Repeated rows repeat; a null
    doc_id counts as the empty text when folds are dealt. Empty tables give empty results. Of the
    columns beside doc_id and text only ``n_chars`` is read, where there is one of whole numbers.
    """
    return scores(docs, train(docs, labels)).select(
        "doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
