"""Spelling variants by a rare-first filter on positional bigrams.

All bigrams are put in one order by the number of words that hold them, the rarest first. A word stands for the join by its three
rarest bigrams alone (by each place of one that repeats): an edit touches two bigrams at most, so two words that
differ by one edit share one of these that the edit leaves alone. Its place in both words is limited: what stands on
one side of it, bigram included, is the same in both, since the edit is on the other side; and of that other side
one half is the same too. So words meet on the longer word's length and the hash of what both must share, and what meets is
verified. Words of more than LONG code points meet on their halves, one of which an edit leaves alone.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, read_table, release

RUN = "A-Za-zÀ-ÿ"
DELETE_ONE_IN, LEAST_LENGTH, LEAST_COUNT, RATIO = 31, 7, 2, 10
#: The rarest bigrams of a word that it joins by: one more than an edit can touch.
RAREST = 3
LONG = 64
#: Distinct words that a task counts before it sends their partial counts on.
HELD = 200_000


def word_counts(docs: DataFrame, delete_one_in: int = DELETE_ONE_IN, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, in lower case (A to Z alone), of ``least_length`` code points and ``least_count`` occurrences or more.

    Words are maximal runs of letters; from each run whose crc32 with the id is divisible by ``delete_one_in`` one code point is
    deleted first. Null and empty texts have none; a null doc_id counts as the empty text; repeated rows count
    again; columns other than doc_id and text are ignored. Tasks send partial counts, never occurrences.
    """
    if least_length < RAREST + 1:
        raise ValueError(f"words of fewer than {RAREST + 1} code points have too few bigrams to join by")
    runs = re.compile(f"[{RUN}]{{{least_length},}}")  # shorter runs give no word

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                lowered = text.as_py().encode().lower().decode()  # of bytes: A to Z alone
                start = zlib.crc32(f"{'' if doc_id.as_py() is None else doc_id.as_py()}:".encode())
                for run, n in Counter(runs.findall(lowered)).items():
                    h = zlib.crc32(run.encode(), start)
                    if h % delete_one_in == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < least_length:
                            continue
                    held[run] += n
                if len(held) >= HELD:
                    yield sent(held)
                    held = Counter()
        if held:
            yield sent(held)

    def sent(held: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

    found = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(partial, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def bigram_order(words: DataFrame) -> dict[str, int]:
    """The place of each bigram of these words in the order by the number of words that hold it, the rarest first.

    Over RUN's alphabet there are at most 90 times 90 bigrams, however many words.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                held.update({word[i : i + 2] for i in range(len(word) - 1)})
        yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["bigram", "words"])

    counts = words.select("word").mapInArrow(partial, "bigram string, words long").groupBy("bigram").agg(F.sum("words").alias("words")).collect()
    return {r["bigram"]: k for k, r in enumerate(sorted(counts, key=lambda r: (r["words"], r["bigram"])))}


def _prefix(word: str, order: dict[str, int]) -> list[int]:
    """The places of the word's rarest bigrams: of RAREST of them, and of those equal to the last."""
    ranks = [order[word[i : i + 2]] for i in range(len(word) - 1)]
    most = sorted(ranks)[RAREST - 1] if len(ranks) >= RAREST else len(order)
    return [i for i, r in enumerate(ranks) if r <= most]


def join_keys(word: str, order: dict[str, int]) -> tuple[set[str], set[str]]:
    """The keys by which a word looks for words of its length or one code point more, and those by which it is found.

    A key names the longer word's length and what both words share. The part that is edited is halved where it has one code
    point less; the longer word leaves out the one between its halves, and so may a word of the same length.
    """
    n = len(word)
    asks, answers = set(), set()
    if n <= LONG + 1:
        for i in _prefix(word, order):
            left, after, right, before = word[: i + 2], word[i + 2 :], word[i:], word[:i]
            if after:
                half = (len(after) - 1) // 2
                answers |= {f"{n}<{left}{after[:half]}|", f"{n}<{left}|{after[half + 1 :]}"}
            if before:
                half = (len(before) - 1) // 2
                answers |= {f"{n}>|{before[half + 1 :]}{right}", f"{n}>{before[:half]}|{right}"}
            if n <= LONG:
                half = len(after) // 2
                asks |= {f"{n + 1}<{left}{after[:half]}|", f"{n + 1}<{left}|{after[half:]}"}
                half = len(before) // 2
                asks |= {f"{n + 1}>|{before[half:]}{right}", f"{n + 1}>{before[:half]}|{right}"}
        if n <= LONG:
            asks |= answers
    if n > LONG:
        half = n // 2
        equal = {f"{n}e{word[:half]}", f"{n}f{word[half:]}"}
        asks |= equal | {f"{n + 1}i{word[:half]}", f"{n + 1}j{word[half:]}"}
        answers |= equal
    if n > LONG + 1:  # the halves of a word that lacks one of its code points
        half = (n - 1) // 2
        answers |= {f"{n}i{word[:half]}", f"{n}j{word[half + 1 :]}"}
    return asks, answers


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): each pair of words (word, n) that differ by exactly one inserted, deleted or replaced code point, once from
    either side. The rows of a word are together.

    ``words`` is read three times, so it should be a table.
    """
    held = words.sparkSession.sparkContext.broadcast(bigram_order(words))  # at most 90 times 90 bigrams

    def keyed(asking: bool):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for k in range(0, batch.num_rows, 2000):
                    part = batch.slice(k, 2000)
                    at, keys = [], []
                    for i, word in enumerate(part.column(0).to_pylist()):
                        own = join_keys(word, held.value)[not asking]
                        at += [i] * len(own)
                        keys += [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in own]
                    picked = part.take(pa.array(at, pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *picked.columns], names=["key", "word", "n"])

        return rows

    ask, answer = (words.select("word", "n").mapInArrow(keyed(x), "key long, word string, n long") for x in (True, False))
    a, b = (x.select("key", F.col("word").alias(k), F.col("n").alias(f"{k}_n")) for x, k in ((ask, "a"), (answer, "b")))
    once = (F.char_length("a") < F.char_length("b")) | (F.col("a") < F.col("b"))
    pairs = a.join(b.hint("merge"), "key").where(once & (F.levenshtein("a", "b", 1) == 1))
    sides = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")), F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(sides.alias("x")).select("x.*").repartition("word").distinct()  # a word has a bounded number of near words


def variants(docs: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of ``word_counts``: word, form, root, n, n_near, form_n.

    ``form``: of the word's near words the one of largest n (ties: the smallest in code-point order) if that is ``ratio`` times
    the word's n or more, else null; ``root``: where following forms ends, the word itself without a form. A
    form's n is at least ``ratio`` times as large, so a chain has at most 19 steps. An empty table, and texts without words, give no
    rows. Tables of words meet by sorting and are never broadcast: a broadcast goes through the driver.
    """
    words = materialize(word_counts(docs), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    known = words.join(near.hint("merge"), "word", "left")
    form_n = -F.col("best.less")
    has = F.coalesce(form_n >= ratio * F.col("n"), F.lit(False))
    made = materialize(
        known.select("word", F.when(has, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, form_n).alias("form_n")),
        "forms",
    )
    steps = made.where("form is not null").select(F.col("word").alias("at"), F.col("form").alias("next"))
    ends, walking = [], made.where("form is not null").select("word", F.col("form").alias("at"))
    while True:
        step = materialize(walking.join(steps.hint("merge"), "at", "left"), "roots")
        ends.append(step.where("next is null").select("word", F.col("at").alias("root")))
        walking = step.where("next is not null").select("word", F.col("next").alias("at"))
        if walking.isEmpty():
            break
    roots = ends[0]
    for more in ends[1:]:
        roots = roots.unionByName(more)
    out = made.join(roots.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
    release(words)
    return out


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(read_table(spark, sf_dir, "documents"))


def _crc_entry(i: int) -> int:
    for _ in range(8):
        i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
    return i


#: crc32 of the bytes that x holds in hexadecimal digits.
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(x) // 2 + 1), lambda i: CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT))),
    lambda c, b: xor(c >> 8, list_extract([{", ".join(map(str, map(_crc_entry, range(256))))}]::BIGINT[], (xor(c, b) & 255) + 1))), 4294967295)"""
SQL = rf"""
WITH RECURSIVE r AS (
  SELECT doc_id, run, count(*) AS times FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
  ) GROUP BY ALL
), h AS (
  SELECT run, times, {_CRC} AS h FROM (SELECT run, times, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM r WHERE length(run) >= {LEAST_LENGTH})
), w AS (
  SELECT word, sum(times)::BIGINT AS n FROM (
    SELECT CASE WHEN h % {DELETE_ONE_IN} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM h
  ) WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(times) >= {LEAST_COUNT}
), d AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, n, CAST(unnest(range(1, length(word) + 1)) AS INT) AS i FROM w)
), p AS (
  SELECT a.word AS a, a.n AS a_n, b.word AS b, b.n AS b_n FROM d a JOIN d b ON a.cut = b.cut AND a.i = b.i AND a.word < b.word
  UNION SELECT w.word, w.n, d.word, d.n FROM w JOIN d ON w.word = d.cut
), e AS (
  SELECT a AS word, b AS near, b_n AS near_n FROM p UNION ALL SELECT b, a, a_n FROM p
), b AS (
  SELECT word, n, count(near) AS n_near, max(near_n) AS most, first(near ORDER BY near_n DESC, near) AS best FROM w LEFT JOIN e USING (word) GROUP BY word, n
), f AS (
  SELECT word, CASE WHEN most >= {RATIO} * n THEN best END AS form, n, n_near, CASE WHEN most >= {RATIO} * n THEN most END AS form_n FROM b
), g AS (
  SELECT word, word AS here, 0 AS steps FROM f UNION ALL SELECT g.word, f.form, steps + 1 FROM g JOIN f ON f.word = g.here WHERE f.form IS NOT NULL
), o AS (SELECT word, max_by(here, steps) AS root FROM g GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM f JOIN o USING (word)
"""
