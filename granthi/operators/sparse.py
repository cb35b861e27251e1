"""The character-trigram index and BM25 over it.

Postings are stored in blocks: a gram's chunks whose contributions fall into one of LEVELS equal levels and whose idx lie in one range.
A block knows its greatest contribution. So a gram of every chunk is many blocks, read by many tasks, and a
top-k reads the levels of great contributions first and of the others those ranges alone that can still matter.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, squeezed

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Levels of contributions, the greatest first; chunks of one range of idx (32,767 at most); ranges whose postings meet in one task.
LEVELS, RANGE, GROUP = 4, 4096, 128
#: Characters that a task turns into postings at once.
LOT = 1_000_000
#: So many chunk numbers at most are sent to all tasks.
FEW_IDS = 1_000_000
#: Partitions of the saved blocks by their grams' hashes: a query reads those of its grams alone.
BUCKETS = 32
#: A top-k first reads levels until what is unread adds at most this share of what a chunk can reach.
FIRST = 0.7
#: Sums of one score in another order differ by less than this.
SLACK = 1e-6


def postings(chunks: DataFrame, text: str = "search_text") -> DataFrame:
    """(idx, gram, tf), counted where the texts are: only chunks that share their idx (or have none) are shuffled, as counts. One job finds these."""
    kind = chunks.schema["idx"].dataType.simpleString()

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _sliced(batches):
            yield _posting_rows(lot.column(0), lot.column(1).to_pylist())

    def counted(some: DataFrame) -> DataFrame:
        return some.select("idx", squeezed(F.col(text)).alias("text")).mapInArrow(made, f"idx {kind}, gram string, tf long")

    shared = chunks.groupBy("idx").agg(F.count("*").alias("chunks")).where("chunks > 1 or idx is null").select(F.col("idx").alias("shared"))
    n = shared.count()
    if not n:
        return counted(chunks)
    few, same = (F.broadcast(shared) if n <= FEW_IDS else shared), F.col("idx").eqNullSafe(F.col("shared"))
    together = counted(chunks.join(few, same, "left_semi")).groupBy("idx", "gram").agg(F.sum("tf").alias("tf"))
    return counted(chunks.join(few, same, "left_anti")).unionByName(together)


def document_counts(chunks: DataFrame, text: str = "search_text") -> DataFrame:
    """(gram, df) from the chunks themselves: each chunk's distinct grams, so that only partial counts are shuffled."""
    return chunks.select(F.explode(F.array_distinct(char_ngrams(F.col(text)))).alias("gram")).groupBy("gram").agg(F.count("*").alias("df"))


def lengths(chunks: DataFrame, text: str = "search_text") -> DataFrame:
    """(idx, dl): the grams of each chunk, without building them."""
    n = F.length(squeezed(F.col(text)))
    return chunks.select("idx", F.when(n <= 3, F.least(n, F.lit(1))).otherwise(n - 2).cast("long").alias("dl"))


def lots(chunks: DataFrame, text: str = "search_text") -> DataFrame:
    """(bucket, range, grams, counts, steps, tfs, docs, lens): the postings of a task's lot of texts by bucket of grams and range of chunks.

    One row holds some thousand grams: ``counts`` are their postings, whose chunks and frequencies follow in ``steps`` (a chunk's
    place among ``docs`` less that of the gram's chunk before) and ``tfs``; ``docs`` are the row's chunks, each less the one before,
    from the range's beginning, ``lens`` their lengths. All are ``_packed``, so a posting takes a byte or two on its way and
    while it is sorted, and a gram of one chunk no row of its own.
    """
    width = RANGE

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _sliced(batches):
            yield _lot_rows(lot.column(0).to_numpy(), lot.column(1).to_pylist(), width)

    rows = chunks.select(F.col("idx").cast("long").alias("idx"), squeezed(F.col(text)).alias("text"))
    return rows.mapInArrow(made, "bucket int, range long, grams binary, counts binary, steps binary, tfs binary, docs binary, lens binary")


def blocks(chunks: DataFrame, mean_length: float, text: str = "search_text") -> DataFrame:
    """(bucket, gram, level, range, top, ids, tfs, dls): a gram's chunks of one level and range, whichever tasks met them.

    ``ids`` count from the range's beginning, ``tfs`` and ``dls`` are what contributions are made of: small numbers, which take a third
    of the room that chunk numbers and contributions would. ``top``: the greatest contribution at weight 1.
    The lots meet by bucket and GROUP ranges, so what a task gets does not grow with the number of chunks. They are sorted as they
    come, packed; blocks, many times as large, leave by bucket and range, in each by gram and level, and are not sorted again.
    """
    width = RANGE

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            for i, now in enumerate(keys):
                if now != key:
                    if held:
                        yield _blocks(*key, held, mean_length, width)
                    key, held = now, []
                held.append([c[i].as_py() for c in batch.columns[2:]])
        if held:
            yield _blocks(*key, held, mean_length, width)

    group = F.floor(F.col("range") / GROUP)
    met = lots(chunks, text).repartition("bucket", group).sortWithinPartitions("bucket", "range")
    return met.mapInArrow(merged, BLOCKS)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (idx, text) in lots of about LOT characters; those without any are left out."""
    for batch in batches:
        start = size = 0
        for k, n in enumerate(pc.utf8_length(batch.column(1)).to_pylist()):
            size += n
            if size >= LOT or k == batch.num_rows - 1:
                if size:
                    yield batch.slice(start, k + 1 - start)
                start, size = k + 1, 0


def _grams(text: str) -> Counter[str]:
    return Counter([text[i : i + 3] for i in range(max(len(text) - 2, 1))] if text else [])


#: What a text of one or two characters is filled up with; no text holds it.
FILL = "\ud800"


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The codes of the distinct trigrams of texts, none empty, in order, and for each place of a trigram its number among these and its text's."""
    padded = [t if len(t) > 2 else t + FILL * (3 - len(t)) for t in texts]
    chars = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in padded])
    whole = doc[:-2] == doc[2:]  # three characters of one text
    codes, gram = np.unique(((chars[:-2] << 42) | (chars[1:-1] << 21) | chars[2:])[whole], return_inverse=True)
    return codes, gram, doc[:-2][whole]


def _names(codes: np.ndarray) -> np.ndarray:
    """The trigrams of these codes as text."""
    chars = _points(codes).T.astype(np.uint32).tobytes().decode("utf-32-le", "surrogatepass")
    return np.array([chars[k : k + 3].rstrip(FILL) for k in range(0, len(chars), 3)], object)


def _points(codes: np.ndarray) -> np.ndarray:
    """Three rows: the first, second and third code points of these codes."""
    return np.stack([codes >> 42, (codes >> 21) & 0x1FFFFF, codes & 0x1FFFFF])


#: For numbers on their way: the quickest level, which packs them as well as higher ones.
ZSTD = pa.Codec("zstd", compression_level=1)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers from 0 below 2^31, compressed behind their count: all lowest bytes, then all second ones, and so on, so that small ones take a byte at most."""
    planes = np.ascontiguousarray(numbers, "<i4").view(np.uint8).reshape(-1, 4).T
    return len(numbers).to_bytes(4, "little") + ZSTD.compress(planes.tobytes(), asbytes=True)


def _unpacked(held: bytes) -> np.ndarray:
    n = int.from_bytes(held[:4], "little")
    planes = np.frombuffer(ZSTD.decompress(held[4:], 4 * n, asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel()


def _posting_rows(idx: pa.Array, texts: list[str]) -> pa.RecordBatch:
    held = [k for k, t in enumerate(texts) if t]
    codes, gram, doc = _trigrams([texts[k] for k in held])
    names = _names(codes)
    pair, tf = np.unique(doc * len(names) + gram, return_counts=True)
    doc, gram = np.divmod(pair, len(names))
    return pa.RecordBatch.from_arrays([idx.take(pa.array(np.array(held)[doc])), pa.array(names, pa.string()).take(pa.array(gram)), pa.array(tf, pa.int64())], names=["idx", "gram", "tf"])


def _lot_rows(idx: np.ndarray, texts: list[str], width: int) -> pa.RecordBatch:
    order = np.argsort(idx, kind="stable")
    order = order[[bool(texts[k]) for k in order]]  # texts without characters have no grams
    idx, texts = idx[order], [texts[k] for k in order]
    dl = np.array([max(len(t) - 2, 1) for t in texts], np.int32)
    codes, gram, doc = _trigrams(texts)
    # by bucket, range, gram and chunk
    buckets = np.array([_bucket(g) for g in _names(codes)], np.int64)
    by_bucket = np.argsort(buckets, kind="stable")
    place = np.empty_like(by_bucket)
    place[by_bucket] = np.arange(len(by_bucket))
    codes, buckets = codes[by_bucket], buckets[by_bucket]
    pair, tf = np.unique(place[gram] * len(texts) + doc, return_counts=True)
    gram, chunk = np.divmod(pair, len(texts))
    parts, part_of = np.unique(idx // width, return_inverse=True)
    row = buckets[gram] * len(parts) + part_of[chunk]
    order = np.argsort(row, kind="stable")
    row, gram, chunk, tf = row[order], gram[order], chunk[order], tf[order]
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    runs = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])])
    edges = np.searchsorted(part_of, np.arange(len(parts) + 1))  # texts are in order of idx
    at = chunk - edges[part_of[chunk]]
    steps = np.diff(at, prepend=0)
    steps[runs] = at[runs]
    counts = np.diff(np.append(runs, len(row)))
    bucket, part = np.divmod(row[first], len(parts))
    docs = [_packed(np.diff(idx[edges[p] : edges[p + 1]], prepend=parts[p] * width)) for p in range(len(parts))]
    lens = [_packed(dl[edges[p] : edges[p + 1]]) for p in range(len(parts))]
    cut = lambda values, ends: [_packed(values[i:j]) for i, j in zip(ends, ends[1:], strict=False)]
    of = np.append(np.searchsorted(runs, first), len(runs))
    grams = [_packed(_points(codes[gram[runs[i:j]]]).ravel()) for i, j in zip(of, of[1:], strict=False)]
    ends = np.append(first, len(row))
    columns = [grams, cut(counts, of), cut(steps, ends), cut(tf, ends), [docs[p] for p in part], [lens[p] for p in part]]
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(parts[part], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["bucket", "range", "grams", "counts", "steps", "tfs", "docs", "lens"])


def _blocks(bucket: int, part: int, rows: list[list[bytes]], mean_length: float, width: int) -> pa.RecordBatch:
    """The blocks of one bucket and range from its rows of all lots, by gram and level."""
    columns = []
    for row in rows:
        points, counts, steps, tf, docs, lens = map(_unpacked, row)
        points = points.reshape(3, -1).astype(np.int64)
        after = np.cumsum(steps, dtype=np.int64)
        first = np.cumsum(counts) - counts
        at = after - np.repeat(after[first] - steps[first], counts)
        columns.append((np.repeat((points[0] << 42) | (points[1] << 21) | points[2], counts), np.cumsum(docs, dtype=np.int64)[at], tf, lens[at]))
    gram, ids, tf, dl = (np.concatenate(c) for c in zip(*columns, strict=True))
    codes, gram = np.unique(gram, return_inverse=True)
    impact = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean_length))
    level = LEVELS - 1 - np.minimum((impact / (K1 + 1) * LEVELS).astype(np.int64), LEVELS - 1)
    block = gram * LEVELS + level
    order = np.argsort(block * width + ids)
    block, ids, tf, dl, impact = (x[order] for x in (block, ids, tf, dl, impact))
    new = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    gram, level = np.divmod(block[new], LEVELS)
    offsets = pa.array(np.append(new, len(ids)), pa.int32())
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x, kind)) for x, kind in ((ids, pa.int16()), (tf, pa.int32()), (dl, pa.int32()))]
    return pa.RecordBatch.from_arrays(
        [pa.array(_names(codes)[gram], pa.string()), pa.array(level, pa.int32()), pa.array(np.full(len(new), part)), pa.array(np.maximum.reduceat(impact, new)), *lists, pa.array(np.full(len(new), bucket), pa.int32())],
        names=["gram", "level", "range", "top", "ids", "tfs", "dls", "bucket"],
    )


def gram_levels(made: DataFrame) -> DataFrame:
    """(gram, df, levels) from blocks; ``levels``: the greatest contribution, the chunks and the blocks of each level, the greatest first."""
    by_level = made.groupBy("gram", "level").agg(F.max("top").alias("top"), F.sum(F.size("ids")).alias("chunks"), F.count("*").alias("blocks"))
    levels = F.sort_array(F.collect_list(F.struct("level", "top", "chunks", "blocks"))).alias("levels")  # LEVELS at most
    return by_level.groupBy("gram").agg(F.sum("chunks").alias("df"), levels)


def corpus_stats(size: DataFrame, counts: DataFrame) -> DataFrame:
    """One row: chunks, mean length, and the mean idf over the vocabulary."""
    return _with_idf(size.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")), counts)


def _with_idf(n: DataFrame, counts: DataFrame) -> DataFrame:
    """``corpus_stats`` from its first two columns."""
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    # grams of one count share their idf: the mean is taken over the distinct counts, which are few
    by_count = counts.groupBy("df").agg(F.count("*").alias("grams"))
    mean = by_count.crossJoin(F.broadcast(n)).agg((F.sum(F.col("grams") * raw) / F.sum("grams")).alias("mean_idf"))
    return n.crossJoin(mean)


def idf() -> Column:
    raw = F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    return F.when(raw < 0, EPSILON * F.col("mean_idf")).otherwise(raw)


def _weighed(counts: DataFrame, stats: DataFrame) -> DataFrame:
    return counts.crossJoin(F.broadcast(stats)).select("gram", "df", idf().alias("idf"), "n", "avgdl", "levels")  # one row


def bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def index(chunks: DataFrame, text: str = "search_text") -> dict[str, DataFrame]:
    """The index's tables, not saved: blocks, grams (with idf and levels) and stats."""
    size = lengths(chunks, text)
    mean = size.agg(F.avg("dl")).first()[0] or 1.0
    made = blocks(chunks, mean, text)
    counts = gram_levels(made)
    stats = corpus_stats(size, counts)
    return {"blocks": made, "grams": _weighed(counts, stats), "stats": stats}


def save(chunks: DataFrame, path: str, text: str = "search_text") -> None:
    """The index as tables below ``path``: blocks by bucket, sorted by range, gram and level, and grams and statistics made from them.

    The postings are shuffled once, as ``lots``; a task merges what it gets into blocks, range by range, and writes these as they
    come. A common gram's blocks are dealt out by groups of ranges, so it fills many tasks and files.
    """
    spark = chunks.sparkSession
    size = lengths(chunks, text).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    made, before = blocks(chunks, size["avgdl"] or 1.0, text), spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, BUCKETS + 1)  # else Spark would sort all blocks by bucket, though they come so
    try:
        made.write.mode("overwrite").partitionBy("bucket").options(compression="zstd", **{"parquet.block.size": ROW_GROUP}).parquet(f"{path}/blocks")
    finally:
        spark.conf.set(WRITERS, before)
    gram_levels(spark.read.schema(BLOCKS).parquet(f"{path}/blocks")).write.mode("overwrite").parquet(f"{path}/counts")
    counts = spark.read.schema("gram string, df long, levels array<struct<level:int,top:double,chunks:long,blocks:long>>").parquet(f"{path}/counts")
    n = spark.createDataFrame(pa.table({"n": pa.array([size["n"]], pa.int64()), "avgdl": pa.array([size["avgdl"]], pa.float64())}))  # one row: texts are not read again
    _with_idf(n, counts).write.mode("overwrite").parquet(f"{path}/stats")
    weighed = _weighed(counts, spark.read.schema(STATS).parquet(f"{path}/stats")).withColumn("bucket", bucket(F.col("gram")))
    weighed.repartitionByRange("bucket", "gram").sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/grams")
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/counts")
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: The files that a task may have open, one for each bucket that it meets, and bytes of a row group, which bounds what each holds.
WRITERS, ROW_GROUP = "spark.sql.maxConcurrentOutputFileWriters", 16 << 20
STATS = "n long, avgdl double, mean_idf double"
BLOCKS = "gram string, level int, range long, top double, ids array<smallint>, tfs array<int>, dls array<int>, bucket int"
GRAMS = "gram string, df long, idf double, n long, avgdl double, levels array<struct<level:int,top:double,chunks:long,blocks:long>>, bucket int"


def load(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {"blocks": spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), "grams": spark.read.schema(GRAMS).parquet(f"{path}/grams"), "stats": spark.read.schema(STATS).parquet(f"{path}/stats")}


def query_grams(query: str) -> dict[str, int]:
    """A query's grams with their number; each counts as often as it stands."""
    return _grams("".join(query.split()).lower())


@dataclass
class Terms:
    """A query's grams that the index knows: weights, and each one's levels as (level, top, chunks, blocks)."""

    weights: dict[str, float]
    levels: dict[str, list[tuple]]
    n: int  # chunks of the index; 0 where it knows no gram
    mean: float  # their mean length

    def most(self) -> float:
        """The most that a chunk can reach."""
        return sum(w * self.levels[g][0][1] for g, w in self.weights.items())

    def upto(self, goal: float) -> dict[str, int]:
        """For each gram the first level to leave unread, so that what is unread adds at most ``goal``."""
        at = dict.fromkeys(self.weights, 0)
        left = {g: self.weights[g] * self.levels[g][0][1] for g in at}
        while at and sum(left.values()) > max(goal, 0.0):
            g = max(left, key=left.get)
            at[g] += 1
            left[g] = self.weights[g] * self.levels[g][at[g]][1] if at[g] < len(self.levels[g]) else 0.0
        return {g: self.levels[g][k][0] if k < len(self.levels[g]) else LEVELS for g, k in at.items()}

    def unread(self, cut: dict[str, int]) -> dict[str, float]:
        """The most that each gram adds from its levels at or beyond its cut."""
        return {g: w * max((x[1] for x in self.levels[g] if x[0] >= cut[g]), default=0.0) for g, w in self.weights.items()}

    def share(self, cut: dict[str, int]) -> float:
        """The share of the query's blocks before the cut."""
        return sum(x[3] for g in self.weights for x in self.levels[g] if x[0] < cut[g]) / max(1, sum(x[3] for g in self.weights for x in self.levels[g]))


def terms(found: dict[str, DataFrame], query: str) -> Terms:
    """One row for each gram of the query that the index holds."""
    times = query_grams(query)
    rows = _of(found["grams"], [*times]).select("gram", "idf", "n", "avgdl", "levels").collect()
    return Terms({r["gram"]: times[r["gram"]] * r["idf"] for r in rows}, {r["gram"]: [tuple(x) for x in r["levels"]] for r in rows}, rows[0]["n"] if rows else 0, rows[0]["avgdl"] if rows else 1.0)


def _of(table: DataFrame, grams: list[str]) -> DataFrame:
    """The rows of these grams, by the bucket where there is one: only these partitions are listed and read."""
    rows = table.where(F.col("gram").isin(*(grams or [""])))
    if "bucket" in table.columns and grams:
        rows = rows.where(F.col("bucket").isin(*{_bucket(g) for g in grams}))
    return rows


def _bucket(gram: str) -> int:
    """``bucket`` of a gram at hand: Spark's xxhash64 is the public function with seed 42."""
    h = xxhash.xxh64_intdigest(gram.encode(), 42)
    return (h - (1 << 64) if h >> 63 else h) % BUCKETS


def _weight(of: dict[str, float]) -> Column:
    return F.element_at(F.map_from_arrays(F.array(*map(F.lit, of)), F.array(*(F.lit(float(x)) for x in of.values()))), F.col("gram"))


def impact(tf: Column, dl: Column, mean: Column | float) -> Column:
    """A posting's contribution at weight 1."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))


def contributions(made: DataFrame, asked: Terms) -> DataFrame:
    """(idx, gram, part): what each posting of these blocks adds; ``part`` has the gram's weight."""
    if not asked.weights:
        return made.select(F.lit(0).cast("long").alias("idx"), "gram", F.lit(0.0).alias("part")).limit(0)
    rows = made.select("gram", "range", _weight(asked.weights).alias("weight"), F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    return rows.select((F.col("range") * RANGE + F.col("p.ids")).alias("idx"), "gram", (F.col("weight") * impact(F.col("p.tfs"), F.col("p.dls"), asked.mean)).alias("part"))


def bm25(found: dict[str, DataFrame], query: str) -> DataFrame:
    """(idx, bm25) of the chunks that share a gram with the query; all others score 0."""
    asked = terms(found, query)
    return contributions(_of(found["blocks"], [*asked.weights]), asked).groupBy("idx").agg(F.sum("part").alias("bm25"))


def bm25_top(found: dict[str, DataFrame], query: str, k: int, asked: Terms | None = None) -> DataFrame:
    """(idx, bm25) of a set of chunks that holds the ``k`` best (and all that tie with the last of them to within SLACK).

    First the levels of great contributions are read: they give each chunk a part of its score, and a bound by the greatest
    contributions of those grams that it was not met in. The k-th greatest part bounds the k-th score from below; levels are
    read until no chunk beyond those met can reach it, and chunks whose bound is less leave. For the others the unread blocks of their ranges complete the score.
    """
    asked = asked or terms(found, query)
    mine = _of(found["blocks"], [*asked.weights])
    cut = asked.upto(FIRST * asked.most())
    for again in (False, True):
        if not asked.weights or min(asked.weights.values()) < 0 or asked.share(cut) == 1:
            return contributions(mine, asked).groupBy("idx").agg(F.sum("part").alias("bm25"))
        rest = asked.unread(cut)
        first, later = mine.where(F.col("level") < _weight(cut)), mine.where(F.col("level") >= _weight(cut))
        parts = contributions(first, asked).groupBy("idx").agg(F.sum("part").alias("part"), F.sum(_weight(rest)).alias("met"))
        best = parts.select("part").orderBy(F.desc("part")).limit(k).collect()  # k rows
        least = best[-1]["part"] if len(best) == k else 0.0
        if again or sum(rest.values()) < least - SLACK:
            break
        cut = asked.upto(least - 2 * SLACK)  # so far that no chunk that was not met can be among the best
    bound = F.col("part") + sum(rest.values()) - F.col("met")
    open_chunks = parts.where(bound >= least - SLACK)
    ranges = open_chunks.select(F.expr(f"idx div {RANGE}").alias("range")).distinct()
    more = contributions(later.join(ranges, "range", "left_semi"), asked).join(open_chunks.select("idx"), "idx", "left_semi")
    both = open_chunks.select("idx", "part").unionByName(more.select("idx", "part"))
    return both.groupBy("idx").agg(F.sum("part").alias("bm25"))


#: Pairs of a query and a gram that are sent to all tasks at most (16 bytes each).
SENT = 1_000_000
#: Queries that a task scores at once against a range of chunks, and grams that it multiplies at once.
QUERIES, GRAMS_AT_ONCE = 256, 512


class _Lot:
    """The scores of one lot of queries over one range of chunks."""

    def __init__(self, base: int, width: int, at_once: int):
        self.base, self.width, self.at_once = base, width, at_once
        self.queries: dict[int, int] = {}
        self.scores = np.zeros((0, width))
        self._clear()

    def _clear(self) -> None:
        self.rows: list[tuple[int, int, float]] = []  # query, gram, weight
        self.grams: dict[str, int] = {}
        self.matrix = np.zeros((self.at_once, self.width))

    def add(self, gram: str, ids: np.ndarray, impacts: np.ndarray, ask: pa.ListScalar) -> None:
        if gram not in self.grams:  # of a gram's many blocks the first one brings its queries
            if len(self.grams) == self.at_once:
                self.multiply()
            self.grams[gram] = len(self.grams)
            self.rows += [(self.queries.setdefault(x["query_id"], len(self.queries)), self.grams[gram], x["weight"]) for x in ask.as_py()]
        self.matrix[self.grams[gram], ids] = impacts

    def multiply(self) -> None:
        if len(self.queries) > len(self.scores):
            self.scores = np.concatenate([self.scores, np.zeros((len(self.queries) - len(self.scores), self.width))])
        if self.rows:
            weights = np.zeros((len(self.queries), self.at_once))
            q, g, w = zip(*self.rows, strict=True)
            weights[q, g] = w
            self.scores += weights @ self.matrix
        self._clear()

    def best(self, k: int, places: int) -> pa.RecordBatch:
        """The queries' ``k`` best chunks of the range."""
        self.multiply()
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for query_id, row in self.queries.items():
            score = np.round(self.scores[row], places)
            at = np.flatnonzero(score > 0)
            at = at[np.lexsort((at, -score[at]))[:k]]
            out.append((np.full(len(at), query_id, np.int64), at + self.base, score[at]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], names=["query_id", "idx", "bm25"])


def bm25_many(found: dict[str, DataFrame], queries: DataFrame, k: int, places: int = 6) -> DataFrame:
    """(query_id, rank, idx, bm25): the ``k`` best chunks of each query of a table (query_id, text), scores rounded, ties by idx.

    Queries and blocks meet on their grams, in lots of about QUERIES queries, so that a block travels once for each lot; up to
    SENT pairs of a query and a gram are broadcast, more of them travel with the blocks. A
    task adds up a lot's scores over one range of chunks at a time, as a matrix of QUERIES by RANGE numbers, and sends each
    query's ``k`` best on; these are merged by rank, again ``k`` at most from a task. Repeated query_ids are one query of all
    their texts' grams; a query that shares no gram with a chunk has no row; scores of 0 or less are left out.
    """
    lots = max(1, -(-queries.select("query_id").distinct().count() // QUERIES))
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.explode(char_ngrams(F.col("text"))).alias("gram")).groupBy("query_id", "gram").agg(F.count("*").alias("times"))
    ask = F.struct("query_id", (F.col("times") * F.col("idf")).alias("weight"))
    weighed = asked.join(found["grams"], "gram").groupBy(F.pmod(F.xxhash64("query_id"), F.lit(lots)).alias("lot"), "gram").agg(F.collect_list(ask).alias("ask"))
    made = found["blocks"].select("gram", "range", "ids", "tfs", "dls")
    if asked.count() <= SENT:  # blocks travel once and alone; their queries are where they arrive
        placed = made.join(F.broadcast(weighed.select("lot", "gram")), "gram").repartition("lot", "range").join(F.broadcast(weighed), ["lot", "gram"])
    else:
        placed = made.join(weighed, "gram").repartition("lot", "range")
    placed = placed.select("lot", "range", "gram", "ids", "tfs", "dls", "ask").sortWithinPartitions("lot", "range", "gram")  # last: a join keeps no order

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lot = None, None
        for batch in batches:
            flat = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in (3, 4, 5)]
            grams, ask = batch.column(2).to_pylist(), batch.column(6)
            for i, now in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                if now != key:
                    if lot:
                        yield lot.best(k, places)
                    key, lot = now, _Lot(now[1] * RANGE, RANGE, GRAMS_AT_ONCE)
                ids, tf, dl = (values[offsets[i] : offsets[i + 1]] for offsets, values in flat)
                lot.add(grams[i], ids, tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean)), ask[i])
        if lot:
            yield lot.best(k, places)

    mean = found["stats"].first()["avgdl"] or 1.0
    some = placed.mapInArrow(best, "query_id long, idx long, bm25 double")
    order = Window.partitionBy("query_id").orderBy(F.desc("bm25"), "idx")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "idx", "bm25")
