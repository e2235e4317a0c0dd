"""File listing as a table: folders are listed first, files below each folder in a task of its own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from fnmatch import fnmatchcase

from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType


@dataclass
class Folder(InputPartition):
    """One task: all files below ``path``, or only those in it."""

    path: str
    below: bool


def _shown(info: FileInfo) -> bool:
    return not info.base_name.startswith((".", "_"))


def _children(system: FileSystem, path: str) -> list[FileInfo]:
    return sorted(filter(_shown, system.get_file_info(FileSelector(path))), key=lambda i: i.path)


class _Listing(DataSourceReader):
    def __init__(self, root: str, patterns: list[str], levels: int):
        self.root, self.patterns, self.levels = root, patterns, levels

    def partitions(self) -> list[Folder]:
        system, top = FileSystem.from_uri(self.root)
        found, level = [], [top]
        for _ in range(self.levels):
            found += [Folder(path, False) for path in level]
            level = [i.path for path in level for i in _children(system, path) if i.type == FileType.Directory]
        return found + [Folder(path, True) for path in level]

    def read(self, partition: Folder) -> Iterator[tuple]:
        system, top = FileSystem.from_uri(self.root)
        scheme = self.root.split("://")[0] + "://" if "://" in self.root else ""
        waiting = [partition.path]
        while waiting:
            for info in _children(system, waiting.pop()):
                if info.type == FileType.Directory:
                    if partition.below:
                        waiting.append(info.path)
                elif any(fnmatchcase(info.base_name, p) for p in self.patterns):
                    yield f"{scheme}{info.path}", info.size, info.mtime


class FileListing(DataSource):
    """``spark.read.format("file_listing").load(root)``: path, size (bytes) and modified of every file below.

    Options: ``patterns``, comma-separated globs over file names (``*``), and ``levels``, how many levels
    of folders are listed before the tasks start (1): each folder found is a task, which walks it
    folder by folder and holds no more than one folder's entries. Only names of these first
    folders pass the driver. Names that begin with a dot or an underscore are left out. Any file
    system that Arrow opens by its address will do; tasks must reach it too.
    """

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, size long, modified timestamp"

    def reader(self, schema: StructType) -> DataSourceReader:
        patterns = self.options.get("patterns", "*").split(",")
        return _Listing(self.options["path"], patterns, int(self.options.get("levels", "1")))
