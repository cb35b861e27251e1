"""Documents from files, and indexes as tables.

Extraction, OCR and embedding are functions that the caller gives: the library has none of its own.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.text import clean_text, is_valid_script

#: From one file's bytes to its pages: (native text, a handle for OCR) each.
Extractor = Callable[[bytes], list[tuple[str, object]]]
OUTSIDE = re.compile("[^\u0900-\u097f]+")
OCR_LANGUAGES = ("nep", "script/Devanagari", "eng")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, ``spark.checkpoint.dir``; for a local session that names none, one of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="granthi-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def kept(df: DataFrame, tag: str) -> DataFrame:
    """``df``, written to the shared folder and read back: what is made twice or must not change is made once. It goes with the application."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def list_files(spark: SparkSession, path: str, suffix: str = "pdf") -> DataFrame:
    """Files below ``path`` (or the file itself) by suffix in any case; a missing path gives no rows."""
    glob = "*." + "".join(f"[{c.lower()}{c.upper()}]" for c in suffix)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path)


def ocr_languages(installed: list[str]) -> str:
    return "+".join(x for x in OCR_LANGUAGES if x in installed) or "eng"


def in_script(text: str, least_ratio: float = 0.4) -> bool:
    """``is_valid_script`` for a text at hand: 20 characters, and that share of the letters in the Devanagari block."""
    letters = sum(map(str.isalpha, text))
    return len(text.strip()) >= 20 and letters > 0 and sum(map(str.isalpha, OUTSIDE.sub("", text))) >= least_ratio * letters


def extract_pages(files: DataFrame, extract: Extractor, ocr: Callable[[object], str] | None = None, least_ratio: float = 0.4, prepare: Callable[[object], object] = lambda image: image) -> DataFrame:
    """(path, source, page, total_pages, text, error): one row for each page; a file that fails gives one row with its error.

    A document is known by its path; ``source`` is its base name, which others may share. A file that could not be read comes
    with an ``error``. A page whose native text is not in the script goes to ``ocr``, its image through ``prepare`` first (scaling,
    denoising, thresholding). Every file is read once.
    """

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content, error in zip(batch["path"], batch["content"], batch["error"], strict=True):
                name = path.rsplit("/", 1)[-1]
                try:
                    if content is None:
                        raise OSError(error)
                    found = extract(bytes(content))
                    rows = []
                    for k, (text, handle) in enumerate(found, 1):
                        keep = ocr is None or in_script(text, least_ratio)
                        rows.append((path, name, k, len(found), text.strip() if keep else ocr(prepare(handle)), None))
                    out += rows
                except Exception as e:  # noqa: BLE001  the file's error is data
                    out.append((path, name, 0, 0, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "source", "page", "total_pages", "text", "error"])

    error = F.col("error") if "error" in files.columns else F.lit(None).cast("string").alias("error")
    return files.select("path", "content", error).mapInPandas(pages, "path string, source string, page int, total_pages int, text string, error string")


def html_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text): raw pages without scripts, styles and tags. An extension: it stands in for a page extractor."""
    body = F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    text = F.regexp_replace(F.regexp_replace(body, r"(?s)<[^>]*>", " "), r"\s+", " ")
    return pages.select("page_id", "url", F.trim(text).alias("text"))


def valid_pages(pages: DataFrame) -> DataFrame:
    return pages.withColumn("native_ok", is_valid_script(F.col("text"))).withColumn("text", clean_text(F.col("text")))


def save_summary(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").json(path)


def load_summary(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A summary that ``save_summary`` wrote; ``schema``: that of the summary."""
    return spark.read.schema(schema).json(path)


def load_case_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Hand-written summaries, one JSON object for each case; empty where the path is missing."""
    fields = ("introduction", "parties", "lawyers", "key_facts", "legal_questions", "reasoning", "final_order", "legal_principle", "subject", "judges")
    schema = "case_id string, " + ", ".join(f"{f} string" for f in fields)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    inner = "map<string, struct<" + ", ".join(f"{f}: string" for f in fields) + ">>"
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", inner).alias("m"))
    return whole.select(F.explode("m").alias("case_id", "s")).select("case_id", "s.*")
