"""Language-model scoring by deleted interpolation.

Trigram, bigram and unigram estimates are mixed, each order with what the lower ones give; a mixture's weight
depends on how often its context was seen (a bucket for each power of two). The weights are learned by
expectation-maximisation on a deleted part of the training documents, for whose tokens the estimates
come from the counts of the rest; the scores then use the counts of the whole training part. All n-grams of
all training texts are counted. Words and word pairs are counted first: where all training occurrences of a pair
are in one block and no held-out block has it, so are those of the trigrams that hold it, and a pair never seen
in training leaves its trigrams unseen; only the other trigrams are asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exchange as X
from .common import collect_garbage, crc32_mod, materialize, read_table, release, to_partitions
from .ngrams import U, mix, text_words

FOLDS = 10
HELD_OUT, DELETED = 0, 1  # folds: never learned from; the part that the weights are learned on
SMOOTH = 0.1
BUCKETS, BINS, OCTAVE = 40, 640, 8  # of the histogram that expectation-maximisation reads
ROUNDS = 200
END, START = mix(np.array([11, 13], U))
TRAIN, LEARN, HELD = 0, 1, 2  # kinds of blocks: of training documents, of deleted ones, of held-out ones
ANSWER = ("<u8", "<u8", "u1")  # a key's count in the training part, in its deleted part, and whether a held-out block has it


class Block:
    """A block's tokens (words, then an end for each text) as places among its distinct unigrams, bigrams and trigrams."""

    def __init__(self, row: dict, trigrams: bool = False):
        words, at = text_words(X.block_texts(row))
        n = len(at) - 1
        self.offsets = at + np.arange(n + 1)
        self.folds, self.kind = np.array(row["flags"]), row["kind"]
        self.train = np.repeat(self.folds != HELD_OUT, np.diff(self.offsets))
        tokens = np.full(self.offsets[-1], END, U)
        tokens[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))] = words
        first = self.offsets[:-1]
        contexts = np.concatenate([[START], tokens[:-1]])
        contexts[first] = START
        self.unigrams, which = np.unique(np.concatenate([tokens, [START]]), return_inverse=True)
        self.token = which[:-1]
        self.context = np.concatenate([which[-1:], self.token[:-1]])
        self.context[first] = which[-1]
        keys = mix(contexts * U(3) + tokens)
        self.bigrams, self.bigram = np.unique(keys, return_inverse=True)
        self.inner = np.ones(len(tokens), bool)  # places that are not a text's first
        self.inner[first] = False
        if trigrams:
            before = np.concatenate([keys[:1], keys[:-1]])
            self.trigrams, of_inner = np.unique(mix(before * U(5) + tokens)[self.inner], return_inverse=True)
            self.trigram = np.zeros(len(tokens), np.int64)
            self.trigram[self.inner] = of_inner

    def own(self, which: np.ndarray, n: int, places: np.ndarray | None = None) -> np.ndarray:
        """The training counts here of each of ``n`` keys."""
        chosen = self.train if places is None else self.train & places
        return np.bincount(which[chosen], minlength=n)

    def lone(self, bigrams: list[np.ndarray]) -> np.ndarray:
        """Of each trigram whether its training count is the one here, as one of its bigrams shows (see above); from these bigrams' answers."""
        only = bigrams[0] == self.own(self.bigram, len(self.bigrams))
        if self.kind != HELD:
            only &= bigrams[2] == 0
        before = np.concatenate([self.bigram[:1], self.bigram[:-1]])
        out = np.zeros(len(self.trigrams), bool)
        out[self.trigram[self.inner]] = (only[self.bigram] | only[before])[self.inner]
        return out


def _find(row: dict) -> X.Found:
    b = Block(row)
    counts = b.own(b.token, len(b.unigrams))
    counts[np.searchsorted(b.unigrams, START)] = (b.folds != HELD_OUT).sum()
    return [(b.unigrams, counts), (b.bigrams, b.own(b.bigram, len(b.bigrams)))]


def _reply(which: np.ndarray, counts: np.ndarray, kinds: np.ndarray) -> tuple[list[np.ndarray], list[int]]:
    """Each key's answer; over the range, the sums of both counts, and the keys counted."""
    n = int(which.max()) + 1
    both = np.bincount(which, weights=counts, minlength=n)
    deleted = np.bincount(which, weights=counts * (kinds == LEARN), minlength=n)
    held = np.bincount(which, weights=kinds == HELD, minlength=n) > 0
    return [both[which], deleted[which], held[which]], [both.sum(), deleted.sum(), (both > 0).sum()]


def _whole(replies: dict[int, bytes], low: int = 0, high: int = 1 << 62) -> list[np.ndarray]:
    """The answers of the ranges ``low`` to ``high``, joined in the order of their keys."""
    parts = [X.unpack(replies[k], ANSWER) for k in sorted(replies) if low <= k < high]
    return [np.concatenate([p[i] for p in parts]).astype(np.int64) if parts else np.zeros(0, np.int64) for i in range(len(ANSWER))]


def _find_trigrams(first: int):
    def find(row: dict, got: list[dict[int, bytes]]) -> X.Found:
        b = Block(row, trigrams=True)
        ask = ~b.lone(_whole(got[0], first))
        return [(b.trigrams[ask], b.own(b.trigram, len(b.trigrams), b.inner)[ask])]

    return find


def _counts(row: dict, got: list[dict[int, bytes]], first: int, parts: int) -> tuple[Block, list[tuple[np.ndarray, ...]]]:
    """A block and, for all training documents and (``parts`` 2) for their deleted part, every token's counts: of the token,
    its word context, the bigram, its pair context and the trigram. A text's first token has its start as both contexts."""
    b = Block(row, trigrams=True)
    one, two = _whole(got[0], 0, first), _whole(got[0], first)
    ask = ~b.lone(two)
    own = b.own(b.trigram, len(b.trigrams), b.inner)
    out = []
    for i, answer in enumerate(_whole(got[1])[:parts]):
        three = own.copy() if i == 0 or b.kind == LEARN else np.zeros_like(own)
        three[ask] = answer
        context, bigram = one[i][b.context], two[i][b.bigram]
        pair = np.where(b.inner, np.concatenate([bigram[:1], bigram[:-1]]), context)
        trigram = np.where(b.inner, three[b.trigram] if len(three) else 0, bigram)
        out.append((one[i][b.token], context, bigram, pair, trigram))
    return b, out


def _buckets(context: np.ndarray) -> np.ndarray:
    """0 for a context never seen, then one for each power of two."""
    return np.where(context > 0, np.frexp(context.astype(np.float64))[1], 0).clip(0, BUCKETS - 1)


def histogram(context: np.ndarray, ratio: np.ndarray) -> np.ndarray:
    """Tokens by bucket and bin of ``ratio``, the estimate of this order over that of the lower ones (see ``learn_weights``)."""
    at = np.where(ratio > 0, np.rint(np.log2(np.maximum(ratio, 1e-300)) * OCTAVE + BINS // 2).clip(1, BINS - 1), 0)
    return np.bincount(_buckets(context) * BINS + at.astype(np.int64), minlength=BUCKETS * BINS).reshape(BUCKETS, BINS)


def learn_weights(cells: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """An order's weight in each bucket, by expectation-maximisation.

    ``cells[bucket, bin]``: deleted tokens whose n-gram estimate is ``2**((bin - BINS/2)/OCTAVE)`` times that of the
    lower orders; bin 0: whose n-gram was not seen. Buckets without tokens take the weight of the one below.
    """
    ratio = np.exp2((np.arange(BINS) - BINS // 2) / OCTAVE)
    ratio[0] = 0.0
    total = cells.sum(axis=1)
    weight = np.full(len(cells), 0.5)
    for _ in range(rounds):
        share = weight[:, None] * ratio
        share /= share + (1 - weight[:, None])
        weight = np.where(total > 0, (cells * share).sum(axis=1) / np.maximum(total, 1), weight)
        weight = weight.clip(1e-6, 1 - 1e-6)
    weight[0] = 0.0
    for k in range(2, len(weight)):
        if not total[k]:
            weight[k] = weight[k - 1]
    return weight


def mixed(weights: np.ndarray, count: np.ndarray, context: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """An order's probabilities: its estimates mixed with those of the lower ones."""
    weight = weights[_buckets(context)]
    return weight * count / np.maximum(context, 1) + (1 - weight) * lower


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: counts, the unigram score and the interpolated model's log10 probability.

    A null text is empty: the end token alone. A null doc_id counts as the empty text when folds are
    dealt. Repeated rows repeat, and count as often as they stand. With no training documents N and V
    are 0 and the score is the base score; without deleted ones the weights are 0.5. An empty table gives an
    empty result; other columns are ignored.
    """
    fold = crc32_mod(F.col("doc_id"), FOLDS)
    blocks = X.pack_blocks(docs, kind=F.when(fold == HELD_OUT, HELD).when(fold == DELETED, LEARN).otherwise(TRAIN), flag=fold)
    size = blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n"), F.count("*").alias("b")).first()
    low_orders = X.Exchange([to_partitions(24 * X.SHARD_KEYS, size["n"]), to_partitions(6 * X.SHARD_KEYS, size["n"])], _reply, ANSWER)
    replies, sums = low_orders.answers(low_orders.asked(blocks, _find), size["b"])
    first = int(low_orders.firsts(1)[1])
    high_order = X.Exchange([to_partitions(6 * X.SHARD_KEYS, size["n"])], _reply, ANSWER)
    more, _ = high_order.answers(high_order.asked_after(blocks, [replies], _find_trigrams(first)), size["b"])
    start = blocks.select(F.explode("flags").alias("f")).where(f"f <> {HELD_OUT}").agg(F.count("*").alias("n"), F.sum((F.col("f") == DELETED).cast("long")).alias("d")).first()
    one = sums.get(0, [0, 0, 0])
    n, n_deleted, v = one[0] - start["n"], one[1] - (start["d"] or 0), one[2] - (start["n"] > 0)

    def unigram(count: np.ndarray, total: int) -> np.ndarray:
        return (count + SMOOTH) / (total + SMOOTH * (v + 1))

    def learned(two: np.ndarray | None) -> np.ndarray:
        """The weights of the bigrams, or with these given, ``two``, those of the trigrams."""

        def cells(row: dict, got: list[dict[int, bytes]]) -> pa.Table:
            _, (every, gone) = _counts(row, got, first, 2)
            token, context, bigram, pair, trigram = (a - d for a, d in zip(every, gone, strict=True))
            lower = unigram(token, n - n_deleted)
            if two is None:
                found = histogram(context, bigram / np.maximum(context, 1) / lower)
            else:
                found = histogram(pair, trigram / np.maximum(pair, 1) / mixed(two, bigram, context, lower))
            used = np.flatnonzero(found)
            return pa.table({"cell": pa.array(used, pa.int32()), "n": pa.array(found.ravel()[used], pa.int64())})

        mine = blocks.where(F.col("kind") == LEARN)
        near = [r.join(mine.select(F.col("block").alias("source")), "source", "left_semi") for r in (replies, more)]
        out = np.zeros(BUCKETS * BINS)
        for r in X.with_answers(mine, near, cells, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most BUCKETS * BINS rows
            out[r["cell"]] = r["n"]
        return learn_weights(out.reshape(BUCKETS, BINS))

    two = learned(None)
    three = learned(two)

    def score(row: dict, got: list[dict[int, bytes]]) -> pa.Table:
        b, ((token, context, bigram, pair, trigram),) = _counts(row, got, first, 1)
        low = unigram(token, n)
        model = np.log10(mixed(three, trigram, pair, mixed(two, bigram, context, low)))
        sums = lambda x: pa.array(np.add.reduceat(x, b.offsets[:-1]))  # noqa: E731  every text has its end token
        return pa.table(
            {
                "doc_id": pa.array(row["doc_ids"], pa.int64()),
                "held_out": pa.array(b.folds == HELD_OUT),
                "n_tokens": pa.array(np.diff(b.offsets)),
                "n_known": sums((token > 0).astype(np.int64)),
                "train_tokens": pa.array(np.full(len(b.folds), n)),
                "base_score": sums(np.log10(low)),
                "score": sums(model),
            }
        )

    out = materialize(X.with_answers(blocks, [replies, more], score, SCHEMA), "scores")
    release(blocks, replies, more)
    collect_garbage(docs.sparkSession)
    return out


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(read_table(spark, sf_dir, "documents"))
