import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from granthi.llm import spelling


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c < "\x80" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: [x for x in words if distance_one(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def rows():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdeé") for _ in range(64))
    bases = ["abababab", "aaaaaaaa", "aaaaaaaaaaaaaaaa", "çédille÷×", "Straßenbahn", "repeated", long, long + "x", long + "xy", "q" * 300, *("".join(rng.choice("abcß") for _ in range(rng.randint(6, 12))) for _ in range(60))]
    words = []
    for base in bases:
        words += [base] * rng.choice([1, 3, 40, 400])
        for _ in range(12):
            k, edit = rng.randrange(len(base)), rng.randrange(3)
            words += [base[:k] + rng.choice("abcé") * (edit > 0) + base[k + (edit != 1) :]] * rng.choice([1, 2, 5, 30])
    rng.shuffle(words)
    made = [(k, " ".join(rng.choice([w, w.upper(), w]) for w in words[k::50])) for k in range(50)]
    return [*made, (None, "repeated REPEATED repeated-ÉÉÉÉÉÉÉ ÉÉÉÉÉÉÉ"), (None, None), (9, ""), (3, made[3][1]), (60, "ab " * 50_000 + "longest" * 20_000)]


def test_against_brute_force(spark):
    made = rows()
    df = spark.createDataFrame([(*r, "w", 1) for r in made], "doc_id long, text string, word string, n int").repartition(5)
    got = sorted(map(tuple, spelling.variants(df).collect()), key=repr)
    assert got == brute(made)
    assert sum(r[1] is not None for r in got) > 50 and any(r[2] != (r[1] or r[0]) for r in got) and any(len(r[0]) > spelling.LONG + 1 and r[4] for r in got)
    assert spelling.variants(df.limit(0)).isEmpty()


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh"])
def test_pairs_of_one_edit(spark, alphabet):
    """Few letters give many equal bigrams; some words are of the lengths at which the keys change."""
    rng = random.Random(len(alphabet))
    words = {"".join(rng.choice(alphabet) for _ in range(rng.choice([4, 5, 6, 7, 9]))) for _ in range(500)}
    for n in (62, 63, 64, 65, 66, 67):
        base = "".join(rng.choice(alphabet) for _ in range(n))
        words |= {base} | {base[:k] + rng.choice(alphabet) * times + base[k + 1 :] for k in range(0, n, 3) for times in (0, 1, 2)}
    df = spark.createDataFrame([(w, 1) for w in sorted(words)], "word string, n long")
    got = sorted(map(tuple, spelling.near_words(df).select("word", "near", "near_n").collect()))
    assert got == sorted((a, b, 1) for a in words for b in words if distance_one(a, b))


def test_partial_counts(spark, monkeypatch):
    monkeypatch.setattr(spelling, "HELD", 3)
    df = spark.createDataFrame(rows(), "doc_id long, text string").coalesce(2)
    few = {tuple(r) for r in spelling.word_counts(df).collect()}
    monkeypatch.undo()
    assert few == {tuple(r) for r in spelling.word_counts(df).collect()} and few
    with pytest.raises(ValueError, match="too few bigrams"):
        spelling.word_counts(df, least_length=3)
    assert spelling.word_counts(df.where(F.col("text") == "")).isEmpty()


def test_words_are_not_broadcast(spark, monkeypatch):
    """Every table that is joined is one of words: none goes through the driver, however small Spark takes it to be."""
    plans = []
    keep = spelling.materialize

    def seen(df, tag):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, tag)

    monkeypatch.setattr(spelling, "materialize", seen)
    out = spelling.variants(spark.createDataFrame(rows()[:50], "doc_id long, text string"))
    out.collect()
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) >= 3 and not any("Broadcast" in p for p in plans)
