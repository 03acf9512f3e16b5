"""Zip archives as a data source: entries of one archive over many tasks.

The central directory says where entries are, so a task opens an archive and
seeks to its own group of entries; a large archive is no longer one task's work.
Stores are reached by their address (file, s3, gs, hdfs), in tasks too.
"""

from __future__ import annotations

import io
import zipfile
from dataclasses import dataclass
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "archive string, entry string, body string"


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The store of an address, and the path in it."""
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(path)


#: Tasks of a scan, about; above that, groups are put together.
TASKS = 1000


@dataclass
class Group:
    archive: str
    entries: list[str]


@dataclass
class Groups(InputPartition):
    groups: list[Group]


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", ".xml")
        self.group_bytes = int(options.get("groupbytes", 16 << 20))

    def partitions(self) -> list[Groups]:
        """Groups of entries, in order of their names, of about as many bytes each
        (unpacked), one a task, or as many as keep the tasks to TASKS. A broken
        archive has none."""
        files, root = store(self.path)
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        out = []
        for name in sorted(f.path for f in found if f.type == fs.FileType.File and f.path.endswith(".zip")):
            with files.open_input_file(name) as f:
                try:
                    entries = sorted((e.filename, e.file_size) for e in zipfile.ZipFile(f).infolist() if e.filename.endswith(self.suffix))
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where the file is too short for its end to be sought
                    continue
            held, size = [], 0
            for entry, n in entries:
                if held and size + n > self.group_bytes:
                    out.append(Group(name, held))
                    held, size = [], 0
                held.append(entry)
                size += n
            if held:
                out.append(Group(name, held))
        each = -(-len(out) // TASKS)
        return [Groups(out[i : i + each]) for i in range(0, len(out), max(1, each))] or [Groups([])]

    def read(self, partition: Groups):
        for group in partition.groups:
            yield from self.read_group(group)

    def read_group(self, partition: Group):
        files, _ = store(self.path)
        with files.open_input_file(partition.archive) as f, zipfile.ZipFile(f) as z:
            for entry in partition.entries:
                body = z.read(entry).decode("utf-8", "replace")
                yield pa.RecordBatch.from_pydict({"archive": [partition.archive], "entry": [entry], "body": [body]})


class ArchiveSource(DataSource):
    """spark.read.format("archive_entries").option("path", ...), with `suffix` of
    the entries and `groupBytes` a task."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, path: str, suffix: str = ".xml", group_bytes: int = 16 << 20) -> DataFrame:
    """(archive, entry, body) of the entries with that suffix; bodies that are no
    UTF-8 come with replacement characters."""
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("archive_entries").option("path", path).option("suffix", suffix).option("groupBytes", group_bytes).load()


def write_archives(entries: DataFrame, path: str) -> DataFrame:
    """Write (archive, entry, body) as <path>/<archive>.zip, an archive a task,
    and give (archive, n). A task that is run again writes the same file."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        files, root = store(path)
        files.create_dir(root, recursive=True)
        data = io.BytesIO()
        with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
            for entry, body in sorted(zip(rows["entry"], rows["body"], strict=True)):
                z.writestr(zipfile.ZipInfo(entry), body)
        name = rows["archive"].iloc[0]
        with files.open_output_stream(f"{root}/{name}.zip") as f:
            f.write(data.getvalue())
        return pd.DataFrame({"archive": [name], "n": [len(rows)]})

    return entries.groupBy("archive").applyInPandas(pack, "archive string, n long")
