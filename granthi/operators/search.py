"""Hybrid search: case filters, kNN, BM25, lexical overlap, fusion, dominant case, neighbours."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import query as Q
from ..functions.text import lexical_score, normalize_digits
from . import sparse
from .ingest import current

SCORES = ("score", "vector_score", "bm25_score", "lexical_score")
NEIGHBOUR = 0.8
LEXICAL = 0.20
DUMP = 50


def cosine_distance(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def knn(vectors: DataFrame, vector: list[float], n: int, normal: bool = False) -> DataFrame:
    """(idx, vector_score) of the ``n`` nearest vectors of all by cosine distance, ties by idx: an exact scan, no full sort.

    ``normal``: the table's vectors have length 1, so that one product for each row is enough.
    """
    length = sum(float(x) ** 2 for x in vector) ** 0.5 or 1.0
    q = F.array(*(F.lit(float(x) / length) for x in vector))
    dot = F.aggregate(F.zip_with("embedding", q, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    distance = 1 - dot if normal else cosine_distance(F.col("embedding"), q)
    near = vectors.select("idx", F.round(distance, 9).alias("distance")).orderBy("distance", "idx").limit(n)
    return near.select("idx", (1 / (1 + F.col("distance"))).alias("vector_score"))


#: Vectors in a block, of the table and of the queries.
BLOCK, QUERY_BLOCK = 4096, 512


def _vector_blocks(rows: DataFrame, size: int) -> DataFrame:
    """(ids, matrix): the rows (idx, embedding) in blocks of a task's ``size`` rows at most, as matrices of doubles at length 1 (of length 0 as they are)."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, size):
                part = batch.slice(k, size)
                flat = part.column(1).flatten().to_numpy().astype(np.float64)
                matrix = flat.reshape(part.num_rows, -1)
                length = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
                matrix = matrix / np.where(length > 0, length, 1.0)
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([matrix.tobytes()], pa.binary())], names=["ids", "matrix"])

    clean = rows.where("idx is not null and embedding is not null").select(F.col("idx").cast("long").alias("idx"), "embedding")
    return clean.mapInArrow(made, "ids array<long>, matrix binary")


def knn_many(vectors: DataFrame, queries: DataFrame, n: int, places: int = 9) -> DataFrame:
    """(query_id, rank, idx, distance): the ``n`` vectors (idx, embedding) nearest by cosine distance to each query's, ties by idx.

    Both tables become matrices of BLOCK and QUERY_BLOCK rows; every block of queries meets every block of vectors, is multiplied
    with it at once, and sends each query's ``n`` best on, which are merged by rank, ``n`` at most from a task. Distances are
    rounded before they are ranked. Rows without an id or a vector are left out; all vectors have one length.
    """
    asks = _vector_blocks(queries, QUERY_BLOCK).select(F.col("ids").alias("query_ids"), F.col("matrix").alias("query_matrix"))

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, asked = np.array(row["ids"]), np.array(row["query_ids"])
                m, q = (np.frombuffer(row[c]).reshape(len(x), -1) for c, x in (("matrix", ids), ("query_matrix", asked)))
                distance = np.round(1 - q @ m.T, places)
                keep = min(n, len(ids))
                cutoff = np.partition(distance, keep - 1, axis=1)[:, keep - 1 : keep]
                who, at = np.nonzero(distance <= cutoff)
                order = np.lexsort((ids[at], distance[who, at], who))
                who, at = who[order], at[order]
                place = np.arange(len(who)) - np.searchsorted(who, who)
                who, at = who[place < n], at[place < n]
                yield pa.RecordBatch.from_arrays([pa.array(asked[who]), pa.array(ids[at]), pa.array(distance[who, at])], names=["query_id", "idx", "distance"])

    met = _vector_blocks(vectors, BLOCK).crossJoin(asks)  # blocks of a stated query set against all blocks
    some = met.mapInArrow(best, "query_id long, idx long, distance double")
    order = Window.partitionBy("query_id").orderBy("distance", "idx")
    return some.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n).select("query_id", "rank", "idx", "distance")


def fetch_size(top_k: int, candidates: int) -> int:
    return min(3 * min(max(8 * top_k, 20), candidates), 100)


def case_rows(chunks: DataFrame, case_id: str | None, decision_no: str | None) -> DataFrame:
    """The candidates: the case's chunks; where a decision is named, its chunks in place of these, found by number or else by id."""
    out = chunks.where(F.col("case_id") == case_id) if case_id else chunks
    if decision_no and not (case_id and out.isEmpty()):
        out = chunks.where(normalize_digits(F.col("decision_no")) == decision_no)
        if out.isEmpty():
            out = chunks.where(F.col("case_id") == f"decision_{decision_no}")
    return out


def case_dump(rows: DataFrame) -> DataFrame:
    """The first DUMP rows by page and idx, every score 1, the header first, then from the last page."""
    first = rows.orderBy("page", "idx").limit(DUMP)
    order = Window.orderBy(F.desc("is_header"), F.desc("page"), "idx")
    return first.withColumns(dict.fromkeys(SCORES, F.lit(1.0))).withColumn("rank", F.row_number().over(order))


def fused(rows: DataFrame, vector_scores: DataFrame, bm25_scores: DataFrame, query: str, alpha: float) -> DataFrame:
    """Candidates with their four scores. BM25 is divided by its greatest among the candidates (1 if that is not positive)."""
    joined = rows.join(vector_scores, "idx", "left").join(bm25_scores, "idx", "left").withColumns({"vector_score": F.coalesce("vector_score", F.lit(0.0)), "bm25": F.coalesce("bm25", F.lit(0.0))})
    most = rows.select("idx").join(bm25_scores, "idx").agg(F.max("bm25").alias("most"))
    scored = joined.crossJoin(F.broadcast(most)).withColumns(  # one row
        {
            "bm25_score": F.greatest("bm25", F.lit(0.0)) / F.when(F.col("most") > 0, F.col("most")).otherwise(1.0),
            "lexical_score": lexical_score(F.lit(query), F.col("content")),
        }
    )
    total = alpha * F.col("vector_score") + (1 - alpha) * F.col("bm25_score") + LEXICAL * F.col("lexical_score")
    return scored.withColumn("score", F.round(total, 9)).drop("bm25", "most")


def ranked(rows: DataFrame, n: int) -> DataFrame:
    """The best ``n`` rows with their rank; ties by idx."""
    top = rows.orderBy(F.desc("score"), "idx").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "idx")))


def dominant_case(rows: DataFrame, top_k: int) -> DataFrame:
    """(case_id) that holds half of the first max(top_k, 10) rows or more; ties go to the first seen; else empty."""
    window = max(top_k, 10)
    votes = ranked(rows, window).where("coalesce(case_id, '') <> ''").groupBy("case_id").agg(F.count("*").alias("votes"), F.min("rank").alias("first"))
    best = votes.orderBy(F.desc("votes"), "first").limit(1)
    return best.where(F.col("votes") >= window / 2).select("case_id")


def expanded(top: DataFrame, chunks: DataFrame, top_k: int) -> DataFrame:
    """The ranked rows and the chunks before and after each in the same case, whose scores are NEIGHBOUR of its own.

    A chunk appears once, as it came first: rank by rank, the row itself, the one before, the one after.
    """
    role = F.explode(F.array(*(F.struct(F.lit(d).alias("delta"), F.lit(r).alias("role")) for r, d in enumerate((0, -1, 1))))).alias("e")
    events = top.select("idx", "case_id", "rank", *SCORES, role).select((F.col("idx") + F.col("e.delta")).alias("idx"), F.col("case_id").alias("of_case"), "rank", F.col("e.role").alias("role"), *SCORES)
    rows = chunks.join(F.broadcast(events), "idx").where((F.col("role") == 0) | F.col("case_id").eqNullSafe(F.col("of_case")))  # 3 * top_k rows
    share = F.when(F.col("role") == 0, 1.0).otherwise(NEIGHBOUR)
    first = F.row_number().over(Window.partitionBy("idx").orderBy("rank", "role"))
    once = rows.withColumn("first", first).where("first = 1").withColumns({s: F.col(s) * share for s in SCORES})
    order = Window.orderBy(F.desc("score"), "rank", "role")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= 3 * top_k).drop("first", "of_case", "role", "rank").withColumnRenamed("place", "rank")


#: Chunks whose scores without the lexical part are looked at first, and of these so many with it.
HEAD, TRIED = 10_000, 64
#: So many chunks at most are sent to all tasks (24 bytes each) to be scored where their texts are.
SENT = 2_000_000


@dataclass
class Engine:
    """An index to search: the chunk table, its vectors (idx, embedding), its sparse index, and an embedding function."""

    chunks: DataFrame
    vectors: DataFrame
    sparse: dict[str, DataFrame]
    embed: Callable[[str], list[float]]
    normal: bool = False  # whether the vectors have length 1

    def bm25(self, query: str) -> DataFrame:
        return sparse.bm25(self.sparse, query)

    def identify(self, query: str) -> tuple[str, str | None]:
        """Intent and decision number, by the columns' own expressions over a local row: no job is run."""
        row = self.chunks.sparkSession.createDataFrame(pa.table({"q": [query]})).select(Q.intent(F.col("q")).alias("i"), Q.decision_number(F.col("q")).alias("n")).first()
        return row["i"], row["n"]

    def search(self, query: str, top_k: int = 5, alpha: float = 0.15, current_case: str | None = None) -> DataFrame:
        """The hits of a query, with four scores and their rank; ``current_case``: a case_id to stay within."""
        kind, number = self.identify(query)
        if current_case and not number and current_case.startswith("decision_"):
            number = current_case.removeprefix("decision_")
        rows = case_rows(self.chunks, current_case, number)
        if kind in ("CASE_SUMMARY", "CASE_LOOKUP"):
            return case_dump(rows)
        everywhere = not current_case and not number
        asked = sparse.terms(self.sparse, query)
        n = fetch_size(top_k, asked.n if everywhere and asked.n else rows.count())
        near = knn(self.vectors, self.embed(query), n, self.normal)
        bm25 = sparse.contributions(sparse._of(self.sparse["blocks"], [*asked.weights]), asked)
        votes = everywhere and kind != "LIST_CASES"
        best = self._best(rows, everywhere, near, bm25, query, alpha, max(top_k, 10) if votes else top_k)
        case = _dominant(best, top_k) if votes else None
        if case:
            own = [r for r in best if r["case_id"] == case][:top_k]
            if len(own) < top_k:  # the case may have more rows beyond the first ones
                scored = fused(rows, near, bm25.groupBy("idx").agg(F.sum("part").alias("bm25")), query, alpha)
                return ranked(scored.where(F.col("case_id") == case), top_k)
            return self._rows(own)
        top = best[:top_k]
        return self._rows(top) if kind == "LIST_CASES" else expanded(self._rows(top), self._around(top), top_k)

    def _best(self, rows: DataFrame, everywhere: bool, near: DataFrame, bm25: DataFrame, query: str, alpha: float, n: int) -> list[dict]:
        """The ``n`` best rows as (idx, case_id, scores), ties by idx: a few, whatever the input.

        The lexical part adds LEXICAL at most. So the chunks of greatest score without it are scored in full first; then only
        those can enter whose score without it is at most LEXICAL below the n-th best so far. These are among the first
        HEAD, or else are found and scored where they are. No chunk is scored twice, and none whose bound is too low.
        """
        parts = near.select("idx", "vector_score", F.lit(0.0).alias("part")).unionByName(bm25.select("idx", F.lit(0.0).alias("vector_score"), "part"))
        known = parts.groupBy("idx").agg(F.max("vector_score").alias("v"), F.greatest(F.sum("part"), F.lit(0.0)).alias("b"))
        if not everywhere:
            known = known.join(rows.select("idx"), "idx", "left_semi")
        known = known.persist()  # 24 bytes a chunk, read up to three times: postings are added up once
        try:
            return self._best_of(known, rows, near, bm25, query, alpha, n)
        finally:
            known.unpersist()

    def _best_of(self, known: DataFrame, rows: DataFrame, near: DataFrame, bm25: DataFrame, query: str, alpha: float, n: int) -> list[dict]:
        """``_best`` from (idx, v, b) of the chunks that share a gram or are near."""
        order = (F.desc(F.col("v") > 0), F.desc("b"), "idx")  # 100 vectors at most, then the best by BM25
        first = [r.asDict() for r in known.orderBy(*order).limit(HEAD + 100).collect()]
        most = max((r["b"] for r in first), default=0.0) or 1.0
        base = lambda v, b: alpha * v + (1 - alpha) * b / most
        first.sort(key=lambda r: (-base(r["v"], r["b"]), r["idx"]))
        done = self._scored(rows, first[:TRIED], query, alpha, most)
        floor = sorted((r["score"] for r in done), reverse=True)[n - 1] - LEXICAL - 1e-8 if len(done) >= n else 0.0
        if floor <= 0:  # chunks without any gram or vector may enter
            scored = fused(rows, near, bm25.groupBy("idx").agg(F.sum("part").alias("bm25")), query, alpha)
            return [r.asDict() for r in ranked(scored, n).select("idx", "case_id", *SCORES).orderBy("rank").collect()]
        beyond = base(0.0, min((r["b"] for r in first if not r["v"]), default=0.0)) if len(first) == HEAD + 100 else 0.0  # the most that a chunk not among the first has
        if beyond < floor:
            done += self._scored(rows, [r for r in first[TRIED:] if base(r["v"], r["b"]) >= floor], query, alpha, most)
        else:
            others = known.where((base(F.col("v"), F.col("b")) >= floor) & ~F.col("idx").isin(*(r["idx"] for r in first[:TRIED])))
            done += self._full(rows.join(F.broadcast(others) if others.count() <= SENT else others, "idx"), query, alpha, most, n)
        return sorted(done, key=lambda r: (-r["score"], r["idx"]))[:n]

    def _scored(self, rows: DataFrame, some: list[dict], query: str, alpha: float, most: float) -> list[dict]:
        """The four scores of chunks at hand (HEAD and 100 at most): their texts are found by idx, and only the lexical part is made by Spark."""
        of = {r["idx"]: r for r in some}
        mine = rows.where(F.expr(f"idx in ({', '.join(map(str, of))})")) if of else rows.limit(0)
        out = []
        for r in mine.select("idx", "case_id", lexical_score(F.lit(query), F.col("content")).alias("lexical")).collect():
            v, b = of[r["idx"]]["v"], of[r["idx"]]["b"] / most
            out.append({"idx": r["idx"], "case_id": r["case_id"], "score": round(alpha * v + (1 - alpha) * b + LEXICAL * r["lexical"], 9), "vector_score": v, "bm25_score": b, "lexical_score": r["lexical"]})
        return out

    def _full(self, rows: DataFrame, query: str, alpha: float, most: float, n: int) -> list[dict]:
        """The ``n`` best of rows with v and b, scored where they are."""
        scored = rows.select("idx", "case_id", F.col("v").alias("vector_score"), (F.col("b") / most).alias("bm25_score"), lexical_score(F.lit(query), F.col("content")).alias("lexical_score"))
        total = alpha * F.col("vector_score") + (1 - alpha) * F.col("bm25_score") + LEXICAL * F.col("lexical_score")
        return [r.asDict() for r in scored.withColumn("score", F.round(total, 9)).orderBy(F.desc("score"), "idx").limit(n).collect()]

    def _rows(self, best: list[dict]) -> DataFrame:
        """The chunks of rows at hand with their scores and rank."""
        kinds = {"idx": pa.int64(), **dict.fromkeys(SCORES, pa.float64()), "rank": pa.int32()}
        table = pa.table({c: pa.array([k if c == "rank" else r[c] for k, r in enumerate(best, 1)], kind) for c, kind in kinds.items()})
        return self.chunks.where(F.col("idx").isin(*(r["idx"] for r in best)) if best else F.lit(False)).join(F.broadcast(self.chunks.sparkSession.createDataFrame(table)), "idx")  # top_k rows

    def _around(self, best: list[dict]) -> DataFrame:
        return self.chunks.where(F.col("idx").isin(*(r["idx"] + d for r in best for d in (-1, 0, 1))) if best else F.lit(False))


def _dominant(best: list[dict], top_k: int) -> str | None:
    """``dominant_case`` of the first max(top_k, 10) rows at hand."""
    votes: dict[str, int] = {}
    for r in best:
        if r["case_id"]:
            votes[r["case_id"]] = votes.get(r["case_id"], 0) + 1
    case = max(votes, key=votes.get, default=None)  # of equal ones the first seen
    return case if case and votes[case] >= max(top_k, 10) / 2 else None


_ENGINES: dict[tuple[str, str], Engine] = {}


def open_engine(spark: SparkSession, base: str, embed: Callable[[str], list[float]]) -> Engine:
    """The engine over a saved base's present version, opened once; ``clear_engines`` forgets it."""
    at = current(spark, base)
    key = (spark.sparkContext.applicationId, at)
    if key not in _ENGINES:
        _ENGINES[key] = Engine(spark.read.parquet(f"{at}/chunks"), spark.read.parquet(f"{at}/vectors"), sparse.load(spark, f"{at}/sparse"), embed, True)
    return _ENGINES[key]


def clear_engines() -> None:
    _ENGINES.clear()
