"""A corpus pipeline: quality, exact dedup, near dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again
as the next one's docs. All but the last return the columns of documents. The two dedup stages judge
every row by itself, whether its doc_id is null or repeated: one row of each group of copies stays.
Stages read doc_id and text (and n_chars); other columns pass through whatever their names. Null texts
are empty; empty tables pass through empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granthi.llm import dedup, packing, pii, quality, similarity
from granthi.llm.common import materialize, read_table

#: Near duplicates: shingles of five words, four fifths of the union shared.
NEAR_WORDS, NEAR_NUM, NEAR_DEN = 5, 80, 100


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labelled ones among them, rejects go."""
    return quality.accepted(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (white space aside) one row stays: that with the smallest doc_id."""
    rows, key = _keyed(docs)
    return _one_of_each(rows, key, dedup.copies(rows, key))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row stays: that with the smallest doc_id."""
    rows, key = _keyed(docs)
    found = similarity.jaccard_components(rows.select(F.col(key).alias("doc_id"), "text"), NEAR_WORDS, NEAR_NUM, NEAR_DEN)
    return _one_of_each(rows, key, found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("group")))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span of personal data is replaced by its kind."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack(docs)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows, written with a key of their own, and that column's name."""
    key = "pipeline_row"
    while key in {c.lower() for c in docs.columns}:
        key += "_"
    return materialize(docs.withColumn(key, F.monotonically_increasing_id()), "rows"), key


def _one_of_each(rows: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """All rows but those of each group of ``found`` (row, group) that are not its smallest doc_id's, null ones last; of equal ones the smallest key stays."""
    ids = found.join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    first = ids.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias("row"))
    gone = materialize(found.select("row").join(kept, "row", "left_anti").withColumnRenamed("row", key), "gone")  # narrow, and no key is hot
    return rows.join(gone, key, "left_anti").select(*(rows[c] for c in rows.columns if c != key))


STAGES = [
    ("quality_classifier", quality_stage),
    ("exact_dedup", dedup_stage),
    ("jaccard_join", near_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
