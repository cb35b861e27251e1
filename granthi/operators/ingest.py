"""From a folder of files to a saved knowledge base, and from that to an engine.

The base is a folder of versions, each a folder of tables: ``pages`` (errors included), ``chunks``, ``vectors`` (unit length),
``sparse`` (the trigram index), ``counts``, ``files`` and ``cases``. A pointer file names the version that is read. A new ingest
writes a version of its own and switches the pointer last, in one step: one that fails leaves the base as it was, and a
reader never sees tables of two versions.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import files
from . import chunks, sparse


def unit(vector: Column) -> Column:
    """The vector at length 1; one of length 0 stays."""
    length = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(length > 0, F.transform(vector, lambda x: (x / length).cast("float"))).otherwise(vector)


def embedded(rows: DataFrame, embed: Callable[[list[str]], list[list[float]]], batch: int = 2000) -> DataFrame:
    """(idx, embedding) of rows (idx, search_text), at most ``batch`` texts at a time."""

    def vectors(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield pd.DataFrame({"idx": part["idx"], "embedding": embed(part["search_text"].tolist())})

    made = rows.select("idx", "search_text").mapInPandas(vectors, "idx long, embedding array<float>")
    return made.select("idx", unit(F.col("embedding")).alias("embedding"))


POINTER = "CURRENT"


def _store(spark: SparkSession, path: str):
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def current(spark: SparkSession, base: str) -> str:
    """The folder of the base's version that is read."""
    store, at = _store(spark, f"{base}/{POINTER}")
    stream = store.open(at)
    try:
        return f"{base}/{spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, 'UTF-8')}"
    finally:
        stream.close()


def switch(spark: SparkSession, base: str, version: str) -> None:
    """Let the base's readers read ``version``; of the others the one before stays, for those that have it open."""
    jvm = spark.sparkContext._jvm
    store, pointer = _store(spark, f"{base}/{POINTER}")
    before = current(spark, base).rsplit("/", 1)[-1] if store.exists(pointer) else None
    _, fresh = _store(spark, f"{base}/.{POINTER}-{uuid.uuid4().hex}")
    out = store.create(fresh, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(rename, 1)
    over[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(store.makeQualified(fresh), store.makeQualified(pointer), over)
    for status in store.listStatus(store.makeQualified(pointer).getParent()):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            store.delete(status.getPath(), True)


def summary(spark: SparkSession, base: str) -> DataFrame:
    """The base's summary in one row, for a base of few files; its rows are the tables ``counts``, ``files`` and ``cases``."""
    at = current(spark, base)
    return chunks.one_summary(*(spark.read.parquet(f"{at}/{t}") for t in ("counts", "files", "cases")))


def ingest(
    spark: SparkSession,
    path: str,
    out: str,
    extract: files.Extractor,
    embed: Callable[[list[str]], list[list[float]]],
    ocr: Callable[[object], str] | None = None,
    prepare: Callable[[object], object] = lambda image: image,
    suffix: str = "pdf",
    read: Callable[[SparkSession, str, str], DataFrame] = files.list_files,
) -> DataFrame:
    """Read, chunk, embed and index all files below ``path`` into the base ``out``; gives its summary.

    A document is known by its path, so files of one name in two folders are two documents. A file that fails keeps its error
    in ``pages``, counts among the files and gives no chunks. A path without files gives an empty base. ``read``: where the
    files come from, ``files.list_files`` (any store of Hadoop's) or ``lots.file_lots``.
    """
    version = f"v-{uuid.uuid4().hex}"
    at = f"{out}/{version}"
    files.extract_pages(read(spark, path, suffix), extract, ocr, prepare=prepare).write.parquet(f"{at}/pages")
    pages = spark.read.parquet(f"{at}/pages")
    chunks.chunk_table(pages.where("error is null").drop("error")).write.parquet(f"{at}/chunks")
    table = spark.read.parquet(f"{at}/chunks")
    embedded(table, embed).write.parquet(f"{at}/vectors")
    sparse.save(table, f"{at}/sparse")
    chunks.count_row(table, pages).write.parquet(f"{at}/counts")
    chunks.file_rows(pages).repartitionByRange("path").sortWithinPartitions("path").write.parquet(f"{at}/files")
    chunks.case_rows(table).repartitionByRange("case_id").sortWithinPartitions("case_id").write.parquet(f"{at}/cases")
    switch(spark, out, version)
    return summary(spark, out)
