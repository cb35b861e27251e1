"""From pages to the chunk table: one header row for each document, then the chunks of its pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.metadata import case_metadata
from ..functions.text import chunk_sentences, clean_text, sentences
from ..sources.files import kept


def keyed(pages: DataFrame) -> DataFrame:
    """Pages with the path that their document is known by; ``source``, its base name, stands for it where there is none."""
    return pages if "path" in pages.columns else pages.withColumn("path", F.col("source"))


def full_texts(pages: DataFrame) -> DataFrame:
    """(path, source, total_pages, text): page texts in page order, a blank line between them."""
    parts = F.array_sort(F.collect_list(F.struct("page", clean_text(F.col("text")).alias("text"))))
    return keyed(pages).groupBy("path").agg(F.max("source").alias("source"), F.max("total_pages").alias("total_pages"), parts.alias("p")).select(
        "path", "source", "total_pages", F.array_join(F.transform("p", lambda x: x["text"]), "\n\n").alias("text")
    )


def page_texts(pages: DataFrame) -> DataFrame:
    """(path, source, page, text): the same as rows, for documents of any length; blank lines are left to whoever joins them."""
    return keyed(pages).select("path", "source", "page", clean_text(F.col("text")).alias("text"))


def cases(texts: DataFrame, split_names: bool = True) -> DataFrame:
    """(path, source, total_pages and metadata) of each document; its base name stands in for a decision number."""
    return texts.select("path", "source", "total_pages", case_metadata(F.col("text"), F.col("source"), split_names).alias("m")).select("path", "source", "total_pages", "m.*")


def header_text() -> Column:
    """The twelve labelled lines of a document's header row."""
    lines = (
        ("CASE_ID: ", F.col("case_id")),
        ("निर्णय नं.: ", F.col("decision_no")),
        ("मिति: ", F.col("date")),
        ("अदालत: ", F.col("court")),
        ("विषय: ", F.col("subject")),
        ("मुद्दाको प्रकार: ", F.lit("")),
        ("न्यायाधीश: ", F.col("judges")),
        ("पुनरावेदक/निवेदक: ", F.col("parties.appellant")),
        ("प्रत्यर्थी/विपक्षी: ", F.col("parties.respondent")),
        ("पुनरावेदकका कानून व्यवसायी: ", F.col("appellant_lawyer")),
        ("प्रत्यर्थीका कानून व्यवसायी: ", F.col("respondent_lawyer")),
        ("प्रमुख कानूनी प्रावधान: ", F.col("provisions")),
    )
    return F.concat_ws("\n", *(F.concat(F.lit(label), value) for label, value in lines))


def search_text(content: Column) -> Column:
    """A chunk behind its metadata in brackets; what is empty reads UNKNOWN, but for the parties."""
    known = lambda c: F.when(c == "", "UNKNOWN").otherwise(c)
    tags = (
        ("CASE_ID", F.col("case_id")),
        ("DECISION_NO", known(F.col("decision_no"))),
        ("DATE", known(F.col("date"))),
        ("SUBJECT", known(F.col("subject"))),
        ("COURT", known(F.col("court"))),
        ("CASE_TYPE", F.lit("UNKNOWN")),
        ("JUDGES", known(F.col("judges"))),
        ("APPELLANT", F.col("parties.appellant")),
        ("RESPONDENT", F.col("parties.respondent")),
        ("APPELLANT_LAWYER", known(F.col("appellant_lawyer"))),
        ("RESPONDENT_LAWYER", known(F.col("respondent_lawyer"))),
        ("PROVISIONS", known(F.col("provisions"))),
        ("SOURCE", F.col("source")),
        ("PAGE", F.col("page").cast("string")),
    )
    return F.concat(F.concat_ws(" ", *(F.concat(F.lit(f"[{k}="), v, F.lit("]")) for k, v in tags)), F.lit("\n"), content)


def chunk_rows(pages: DataFrame, max_chars: int = 600, overlap: int = 1) -> DataFrame:
    """(path, source, page, total_pages, chunk_no, content, paragraph_no) of all pages; blank chunks are left out.

    ``paragraph_no``: the number of the first paragraph that a chunk names; null without one.
    """
    packed = chunk_sentences(sentences(clean_text(F.col("text"))), max_chars, overlap)
    rows = keyed(pages).select("path", "source", "page", "total_pages", F.posexplode(packed).alias("chunk_no", "content"))
    return rows.where(F.trim("content") != "").withColumn("paragraph_no", F.nullif(F.regexp_extract("content", K.PARAGRAPH_MARKER, 1), F.lit("")))


def with_index(rows: DataFrame, by: tuple[str, ...] = ("path", "page", "chunk_no")) -> DataFrame:
    """Rows numbered from 0 in the order of ``by``.

    Rows are dealt out by ranges, sorted and numbered in each partition, and written; what the partitions before hold is
    added when they are read. So neither a file's rows nor one row for each file meet in one task, and a task
    that is run again reads the same partitions.
    """
    spark = rows.sparkSession
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # its lower bits: the place in the partition
    made = kept(rows, "rows")  # dealing out by ranges reads its input twice
    back = kept(made.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_place": place}), "numbered")
    counts = sorted(back.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each partition
    starts, n = [], 0
    for part, size in counts:
        starts.append((part, n))
        n += size
    table = spark.createDataFrame(starts, "_part int, _start long")
    return back.join(F.broadcast(table), "_part").withColumn("idx", F.col("_start") + F.col("_place")).drop("_part", "_place", "_start")


def chunk_table(pages: DataFrame, max_chars: int = 600, overlap: int = 1, split_names: bool = True) -> DataFrame:
    """The chunk table: header rows (page 0) and page chunks, numbered, each with its case's metadata."""
    meta = cases(full_texts(pages), split_names)
    head = meta.withColumn("content", header_text()).withColumn("search_text", F.col("content")).withColumns({"page": F.lit(0), "chunk_no": F.lit(0), "is_header": F.lit(True), "paragraph_no": F.lit(None).cast("string")})
    body = chunk_rows(pages, max_chars, overlap).join(meta.drop("total_pages", "source"), "path").withColumn("search_text", search_text(F.col("content"))).withColumn("is_header", F.lit(False))
    return with_index(head.unionByName(body))


META = ("source", "decision_no", "date", "subject", "court", "parties", "judges", "appellant_lawyer", "respondent_lawyer", "provisions")


def file_rows(pages: DataFrame) -> DataFrame:
    """(path, source, total_pages, error) of each file, failed ones too, from pages with their errors."""
    error = F.max("error") if "error" in pages.columns else F.lit(None).cast("string")
    return keyed(pages).groupBy("path").agg(F.max("source").alias("source"), F.max("total_pages").alias("total_pages"), error.alias("error"))


def case_rows(chunks: DataFrame) -> DataFrame:
    """(case_id and metadata) of each case, as its first chunk has them."""
    first = F.min_by(F.struct("idx", *META), "idx").alias("m")
    return chunks.groupBy("case_id").agg(first).select("case_id", F.col("m.idx").alias("first_idx"), *(f"m.{c}" for c in META))


def count_row(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """One row: time and counts; every file counts, a failed one with no pages."""
    found = file_rows(pages).agg(F.count("*").alias("total_files"), F.coalesce(F.sum("total_pages"), F.lit(0)).alias("total_pages"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("last_ingested")
    return found.crossJoin(chunks.agg(F.count("*").alias("total_chunks"))).select(now, "*")  # one row each


def one_summary(counts: DataFrame, files: DataFrame, case_table: DataFrame) -> DataFrame:
    """One row: counts, the files' names, cases and their metadata in one cell each, for a reader of few files."""
    names = files.agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "source"))), lambda x: x["source"]).alias("files"))
    by_case = case_table.agg(F.sort_array(F.collect_list("case_id")).alias("cases"), F.map_from_entries(F.collect_list(F.struct("case_id", F.struct(*META).alias("m")))).alias("case_metadata"))
    return counts.crossJoin(names).crossJoin(by_case)  # one row each


def ingest_summary(chunks: DataFrame, pages: DataFrame) -> DataFrame:
    """``one_summary`` of a chunk table and the pages that it was made from."""
    return one_summary(count_row(chunks, pages), file_rows(pages), case_rows(chunks))
