"""The language model and the counting exchange against brute force."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from granthi.llm import exchange as X
from granthi.llm import lm

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [None, "", " \t\n", "The the THE", "é É ü", "the the", "a" * 3000, None]


def corpus(n, seed=4):
    rng = np.random.default_rng(seed)
    rows = [(int(i), " ".join(f"W{int(x)}" for x in rng.zipf(1.3, rng.integers(1, 60)) % 400)) for i in range(n)]
    rows += [(n + i, t) for i, t in enumerate(ODD)]
    return rows + [rows[1], rows[1], (None, "no id at all"), (5, "a second text of one id")]


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in WORDS.findall(text or "")] + ["</s>"]


def grams(text):
    """Of each token: itself, its context, the bigram, the pair context, the trigram; a first token has the start as both contexts."""
    t = tokens(text)
    for i, w in enumerate(t):
        before = t[i - 1] if i else "<s>"
        pair = (t[i - 2] if i > 1 else "<s>", before) if i else ("<s>",)
        yield w, before, (before, w), pair, (*pair, w)


def brute(rows):
    """The interpolated score of every row by counting in dictionaries; the weights by the operator's own algorithm on these counts."""
    fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % lm.FOLDS
    every, gone = Counter(), Counter()
    for i, text in rows:
        for count in [every] * (fold(i) != lm.HELD_OUT) + [gone] * (fold(i) == lm.DELETED):
            count["<s>"] += 1
            for k, (w, _, two, _, three) in enumerate(grams(text)):
                count.update([w, two, *([three] if k else [])])
                count["tokens"] += 1
    v = sum(1 for k in every if isinstance(k, str) and k not in ("<s>", "tokens"))

    def counts(g, rest):
        c = lambda k: every[k] - (gone[k] if rest else 0)
        w, before, two, pair, three = g
        n = c("tokens")
        ctx = c("<s>") if pair == ("<s>",) else c(pair)
        tri = c(two) if pair == ("<s>",) else c(three)
        return np.array([(c(w) + lm.SMOOTH) / (n + lm.SMOOTH * (v + 1)), c(before), c(two), ctx, tri], np.float64)

    seen = np.array([counts(g, True) for i, t in rows if fold(i) == lm.DELETED for g in grams(t)]).reshape(-1, 5).T
    low, before, two, pair, three = seen
    w2 = lm.learn_weights(lm.histogram(before.astype(int), two / np.maximum(before, 1) / low).astype(float))
    middle = lm.mixed(w2, two, before.astype(int), low)
    w3 = lm.learn_weights(lm.histogram(pair.astype(int), three / np.maximum(pair, 1) / middle).astype(float))
    out = []
    for i, t in rows:
        low, before, two, pair, three = np.array([counts(g, False) for g in grams(t)]).T
        model = lm.mixed(w3, three, pair.astype(int), lm.mixed(w2, two, before.astype(int), low))
        out.append((-1 if i is None else i, len(low), round(float(np.log10(low).sum()), 6), round(float(np.log10(model).sum()), 6)))
    return sorted(out)


@pytest.mark.parametrize("block_bytes", [2_000, 12_000_000])
def test_scores_equal_a_brute_force_model(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(X, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(X, "SHARD_KEYS", max(30, block_bytes // 100))
    rows = corpus(300)
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    have = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in got)
    for a, b in zip(have, brute(rows), strict=True):
        assert a[:2] == b[:2] and a[2:] == pytest.approx(b[2:], abs=2e-5)


def test_weights_reach_the_likelihood_of_exact_expectation_maximisation():
    rng = np.random.default_rng(3)
    ratio = np.where(rng.random(4000) < 0.4, 0, np.exp2(rng.normal(3, 3, 4000)))
    context = rng.integers(1, 3000, 4000)
    weights = lm.learn_weights(lm.histogram(context, ratio).astype(float))
    for bucket in set(lm._buckets(context).tolist()):
        own = ratio[lm._buckets(context) == bucket]
        exact = 0.5
        for _ in range(2000):
            exact = float(np.mean(exact * own / (exact * own + 1 - exact)))
        assert weights[bucket] == pytest.approx(exact, abs=0.02)


def test_weights_of_buckets():
    cells = np.zeros((lm.BUCKETS, lm.BINS))
    cells[3, 0], cells[3, -1] = 50, 50
    weights = lm.learn_weights(cells)
    assert weights[0] == 0 and weights[3] == pytest.approx(0.5, abs=0.01) and weights[9] == weights[3]


def test_higher_orders_help(spark):
    rows = [(i, "the cat sat on the mat and the dog sat on the rug") for i in range(60)]
    got = lm.lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").collect()
    assert all(r["score"] > r["base_score"] / 3 for r in got) and all(math.isfinite(r["score"]) for r in got)


@pytest.mark.parametrize(("fan", "steps"), [(256, 1), (8, 2), (3, 4)])
def test_exchange_counts_by_any_number_of_steps(spark, monkeypatch, fan, steps):
    monkeypatch.setattr(X, "FAN", fan)
    monkeypatch.setattr(X, "BLOCK_BYTES", 300)
    rows = [(i, t) for i, t in corpus(150) if t]
    blocks = X.pack_blocks(spark.createDataFrame(rows, "doc_id long, text string"), flag=F.lit(5))
    own = X.Exchange([5, 60], lm._reply, lm.ANSWER)
    assert own.steps == steps
    replies, sums = own.answers(own.asked(blocks, lm._find), blocks.count())
    got = X.with_answers(blocks, [replies], _totals(int(own.firsts(1)[1])), "doc_id long, n long").collect()
    count = Counter(w for _, t in rows for w in tokens(t))
    assert sum(r["n"] for r in got) == sum(count[w] ** 2 for w in count)
    assert sums[0][0] == sum(count.values()) + len(rows)


def _totals(first):
    def use(row, got):
        import pyarrow as pa

        b = lm.Block(row)
        total = lm._whole(got[0], 0, first)[0]
        return pa.table({"doc_id": pa.array([0], pa.int64()), "n": pa.array([int(total[b.token].sum())], pa.int64())})

    return use


def test_requests_grow_in_proportion(spark, monkeypatch):
    """Inputs of 1 : 2 : 4 at constants that make the largest take three steps and more."""
    monkeypatch.setattr(X, "FAN", 4)
    monkeypatch.setattr(X, "BLOCK_BYTES", 400)
    made = []
    for n in (200, 400, 800):
        rows = [(i, t) for i, t in corpus(n) if t]
        blocks = X.pack_blocks(spark.createDataFrame(rows, "doc_id long, text string"))
        senders = blocks.count()
        own = X.Exchange([senders // 2, senders], lm._reply, lm.ANSWER)
        asked = own.asked(blocks, lm._find)
        per_step = [asked.count()]
        for step in range(2, own.steps + 1):
            asked = asked.withColumn("cell", own._cell(step - 1, senders)).groupBy("cell").applyInArrow(own._onwards(step), X.REQUESTS)
            per_step.append(asked.count())
        made.append((own.steps, senders, max(per_step) / senders))
    assert made[-1][0] >= 3
    assert max(x[2] for x in made) < 2.6 * X.FAN  # of each of two classes FAN at most, and cells are rounded up
