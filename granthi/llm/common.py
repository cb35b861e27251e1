"""Session helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

#: A key is hot where it holds more than one row in so many: there are at most that many hot keys, so they can be broadcast.
HOT_SHARE = 2000


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where a local session names none, a new one of this machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="granthi-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage is cut, values that a retried task could make anew differently are fixed, and a
    lost executor costs at most its running tasks. ``release`` deletes what is no longer read; the rest goes
    when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    fs, at = _hadoop(spark, path)
    df.write.option("compression", "zstd").parquet(path)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def release(*kept: DataFrame) -> None:
    """Delete materialized tables that nothing will read again."""
    for df in kept:
        fs, at = _hadoop(df.sparkSession, df._kept_at)
        fs.delete(at, True)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver forget the plans of finished steps: Spark removes a shuffle's files from the executors' disks, and
    gives back a broadcast's memory, once the driver's JVM has collected what refers to them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def look_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """``rows`` with the other columns of ``table`` (null where it has no such keys), which has a row for each key.

    ``weight``: the column of ``table`` that says how many rows hold the key; it is left out of the result. Keys that
    hold more than a HOT_SHARE-th of ``total`` rows are at most HOT_SHARE, whatever the input: they are broadcast, and
    only the others, none of which is hot, are dealt out by key. Both are read twice, so they should be tables.
    """
    hot = F.col(weight) * HOT_SHARE > total
    few, many = table.where(hot).drop(weight), table.where(~hot).drop(weight)
    found = rows.join(F.broadcast(few.withColumn("_hot", F.lit(True))), keys, "left")
    return found.where("_hot").drop("_hot").unionByName(rows.join(F.broadcast(few.select(keys)), keys, "left_anti").join(many, keys, "left"))


def crc32_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo ``m``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % m


def has_count(docs: DataFrame, name: str = "n_chars") -> bool:
    """Whether there is such a column, and of whole numbers: one of another type is not the count that it names, and stays as it is."""
    return name in docs.columns and isinstance(docs.schema[name].dataType, IntegralType)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_partitions(n_rows_per_task: int, total: int) -> int:
    """Tasks for ``total`` units of work, ``n_rows_per_task`` units in each."""
    return max(1, -(-int(total) // n_rows_per_task))


def chunks(texts: pa.Array, chars: int = 2_000_000) -> Iterator[list[str]]:
    """The texts (null: empty) in order, in lists that end once they hold ``chars`` characters."""
    out: list[str] = []
    size = 0
    for text in texts:
        out.append(text.as_py() or "")
        size += len(out[-1])
        if size >= chars:
            yield out
            out, size = [], 0
    if out:
        yield out
