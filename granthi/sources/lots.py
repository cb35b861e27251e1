"""A data source for folders of files: a partition for each lot of files, in batch and as a stream of new files.

``spark.read.format("file_lots")`` after ``register``. A file is known by its full path; one that cannot be read is a row with its
error, and costs no other file of its lot. Folders are reached through Arrow's file systems (local, S3, HDFS, GCS).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modified timestamp, length long, content binary, error string"
#: A lot holds so many files at most, and ends once it holds so many bytes.
LOT_FILES, LOT_BYTES = 500, 64 << 20

Found = tuple[str, int, int]  # path, nanoseconds of its last change, bytes


@dataclass
class Lot(InputPartition):
    files: list[Found]


def listed(root: str, suffix: str) -> list[Found]:
    """Files below ``root``, or the file itself, by suffix in any case and in the order of their paths; a missing path gives none."""
    store, at = fs.FileSystem.from_uri(root)
    info = store.get_file_info(at)
    infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True, allow_not_found=True))
    end = f".{suffix.lower()}"
    return sorted((i.path, i.mtime_ns or 0, i.size or 0) for i in infos if i.type != fs.FileType.Directory and i.path.lower().endswith(end))


def lots(files: list[Found], most_files: int = LOT_FILES, most_bytes: int = LOT_BYTES) -> list[Lot]:
    out: list[Lot] = []
    size = 0
    for f in files:
        if not out or len(out[-1].files) >= most_files or size >= most_bytes:
            out.append(Lot([]))
            size = 0
        out[-1].files.append(f)
        size += f[2]
    return out


def _rows(root: str, files: list[Found]) -> Iterator[tuple]:
    store, _ = fs.FileSystem.from_uri(root)
    for path, changed, size in files:
        when = datetime.fromtimestamp(changed / 1e9, UTC)
        try:
            with store.open_input_stream(path) as f:
                content, error = f.read(), None
        except OSError as e:
            content, error = None, str(e)
        yield path, when, size, content, error


class FileLots(DataSource):
    """Options: ``path``, ``suffix`` (pdf), ``lotFiles`` and ``lotBytes``."""

    @classmethod
    def name(cls) -> str:
        return "file_lots"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LotReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return NewFiles(self.options)


class _Options:
    def __init__(self, options: dict):
        self.root, self.suffix = options["path"], options.get("suffix", "pdf")
        self.most = int(options.get("lotFiles", LOT_FILES)), int(options.get("lotBytes", LOT_BYTES))


class LotReader(_Options, DataSourceReader):
    def partitions(self) -> list[Lot]:
        return lots(listed(self.root, self.suffix), *self.most) or [Lot([])]

    def read(self, partition: Lot) -> Iterator[tuple]:
        return _rows(self.root, partition.files)


class NewFiles(_Options, DataSourceStreamReader):
    """Offsets are the time of change and path of the last file seen: a file that is put in place later must carry a later time."""

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        last = max(((changed, path) for path, changed, _ in listed(self.root, self.suffix)), default=(-1, ""))
        return {"changed": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Lot]:
        after, upto = ((x["changed"], x["path"]) for x in (start, end))
        return lots([f for f in listed(self.root, self.suffix) if after < (f[1], f[0]) <= upto], *self.most)

    def read(self, partition: Lot) -> Iterator[tuple]:
        return _rows(self.root, partition.files)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileLots)


def file_lots(spark: SparkSession, path: str, suffix: str = "pdf", **options: str) -> DataFrame:
    """(path, modified, length, content, error) of the files below ``path``."""
    register(spark)
    return spark.read.format("file_lots").options(path=path, suffix=suffix, **options).load()


def new_files(spark: SparkSession, path: str, suffix: str = "pdf", **options: str) -> DataFrame:
    """The same as a stream: what is there, then what comes."""
    register(spark)
    return spark.readStream.format("file_lots").options(path=path, suffix=suffix, **options).load()
