"""The `casedir` data source: one row for each file below case folders.

`spark.read.format("casedir").load(root)` lists every folder below `root` as a case (option ``single`` = true: root itself is the
case). Hidden files and folders are left out, linked folders are not entered, empty files are kept; files come in the order
of their folded path, which is scan_ord. Content is hashed where it lies, in 64 KiB steps (option ``hash`` = false
leaves it out); with option ``content`` = true files of index formats up to 2 MiB come with their bytes. Each case
folder is a partition. On a cluster `root` must be a folder that all executors mount.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "casefile_id string, filename string, relative_path string, extension string, size_bytes long, sha256 string, scan_ord long, content binary"
INDEX_FORMATS = (".html", ".htm", ".xml", ".txt", ".csv")
MOST_INDEX_BYTES = 2 * 1024 * 1024


def walk(root: str) -> list[str]:
    """Relative paths of the visible files below a folder."""
    found = []
    for folder, folders, files in os.walk(root, followlinks=False):
        folders[:] = [f for f in folders if not f.startswith(".") and not os.path.islink(os.path.join(folder, f))]
        found += [os.path.relpath(os.path.join(folder, f), root).replace(os.sep, "/") for f in files if not f.startswith(".")]
    return sorted(found, key=lambda p: (p.casefold(), p))


def file_sha256(path: str, step: int = 64 * 1024) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while chunk := f.read(step):
            digest.update(chunk)
    return digest.hexdigest()


class _Case(InputPartition):
    def __init__(self, name: str, path: str) -> None:
        self.name, self.path = name, path


class CaseDirReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        flag = lambda name, default: str(options.get(name, default)).lower() == "true"
        self.root, self.single, self.hash, self.content = options["path"], flag("single", "false"), flag("hash", "true"), flag("content", "false")
        if not os.path.exists(self.root):
            raise FileNotFoundError(self.root)
        if not os.path.isdir(self.root):
            raise NotADirectoryError(self.root)

    def partitions(self) -> list[InputPartition]:
        root = os.path.abspath(self.root)
        if self.single:
            return [_Case(os.path.basename(root), root)]
        return [_Case(n, os.path.join(root, n)) for n in sorted(os.listdir(root)) if not n.startswith(".") and os.path.isdir(os.path.join(root, n)) and not os.path.islink(os.path.join(root, n))]

    def read(self, partition: _Case) -> Iterator[tuple]:
        for n, relative in enumerate(walk(partition.path), 1):
            full, name = os.path.join(partition.path, relative), os.path.basename(relative)
            size, extension = os.path.getsize(full), os.path.splitext(name)[1].lower()
            content = None
            if self.content and extension in INDEX_FORMATS and size <= MOST_INDEX_BYTES:
                with open(full, "rb") as f:
                    content = f.read()
            yield partition.name, name, relative, extension, size, file_sha256(full) if self.hash else None, n, content


class CaseDir(DataSource):
    @classmethod
    def name(cls) -> str:
        return "casedir"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return CaseDirReader(self.options)


def register(spark: SparkSession) -> None:
    from spoglio.session import ship

    ship(spark)
    spark.dataSource.register(CaseDir)
