"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Texts never enter a shuffle. A first scan takes each row's length and the hash of its first characters. Rows whose
length is unique leave after the first grouping, rows whose (length, prefix hash) is unique after the
second, and only of the survivors the full content is read and hashed, and they are grouped by it. Groupings are
partial aggregates, so a group that holds a third of all rows shuffles one row per task; what they find is
brought back to the rows by ``look_up``, which deals out no hot key. Where the caller wants every row's digest, as
op8's contract does, the full hash is taken in the first scan: a second read would cost more than hashing
while the text is at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import collect_garbage, look_up, materialize, read_table

PREFIX_CHARS = 256


def fingerprints(docs: DataFrame, full: bool = True) -> DataFrame:
    """(doc_id, len, prefix_hash) of the normalised text, and with ``full`` its text_sha256; null counts as empty."""
    norm = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"[\x20\x09-\x0D]+", " ")
    return docs.select("doc_id", norm.alias("norm")).select(
        "doc_id",
        F.length("norm").alias("len"),
        F.xxhash64(F.substring("norm", 1, PREFIX_CHARS)).alias("prefix_hash"),
        *[F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")] * full,
    )


def _shared(rows: DataFrame, keys: list[str], total: int) -> DataFrame:
    """The rows whose keys another row has too."""
    table = rows.groupBy(*keys).agg(F.count("*").alias("weight")).where("weight > 1").withColumn("there", F.lit(True))
    return look_up(rows, table, keys, "weight", total).where("there").drop("there")


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space became one space; null is
    empty, and empty texts form one group like any other. The smallest doc_id of a group stays (null
    ids count as larger than any; if all are null, they stay). Rows that repeat a doc_id and a text
    are one document: all of them carry its decision and each counts in group_size. An empty table
    gives an empty result. Columns other than doc_id and text are ignored.
    """
    prints = materialize(fingerprints(docs), "fingerprints")
    total = prints.count()
    survivors = _shared(_shared(prints, ["len"], total), ["len", "prefix_hash"], total)
    groups = materialize(
        survivors.groupBy("len", "prefix_hash", "text_sha256")
        .agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
        .where("group_size > 1"),
        "groups",
    )
    joined = look_up(prints, groups.withColumn("weight", F.col("group_size")), ["len", "prefix_hash", "text_sha256"], "weight", total)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )


#: So many survivors at most are sent to all tasks (16 bytes each) to read their texts where they are.
SENT = 2_000_000


def copies(rows: DataFrame, key: str) -> DataFrame:
    """(row, group) of the rows of ``rows`` that have equal texts among the others: their keys and a key for each group.

    ``key``: a column that numbers the rows, each with its own number. Texts are equal as in ``exact_dedup``. The
    full content is read for rows alone that share length and prefix hash with another row. ``rows`` is read twice, so
    it should be a table. An empty table gives an empty result.
    """
    prints = materialize(fingerprints(rows.select(F.col(key).alias("doc_id"), "text"), full=False), "fingerprints")
    total = prints.count()
    survivors = materialize(_shared(_shared(prints, ["len"], total), ["len", "prefix_hash"], total).select("doc_id", "len"), "survivors")
    own = survivors.select(F.col("doc_id").alias(key))
    texts = rows.select(key, "text").join(F.broadcast(own) if survivors.count() <= SENT else own, key, "left_semi")
    full = materialize(fingerprints(texts.select(F.col(key).alias("doc_id"), "text")), "survivors")
    groups = materialize(full.groupBy("len", "text_sha256").agg(F.min("doc_id").alias("group"), F.count("*").alias("weight")).where("weight > 1"), "groups")
    collect_garbage(rows.sparkSession)
    found = look_up(full, groups, ["len", "text_sha256"], "weight", total).where("group is not null")
    return found.select(F.col("doc_id").alias("row"), "group")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
), h AS (SELECT doc_id, sha256(norm) AS text_sha256 FROM t),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY 1)
SELECT h.doc_id, g.keep_id, g.group_size, h.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, h.text_sha256
FROM h JOIN g USING (text_sha256)
"""
