"""A folder's files as a Spark source: rows (path, size, folder), files without bytes too, listed by tasks.

    spark.dataSource.register(FileListing)
    spark.read.format("file_listing").option("glob", "trace_*.json").option("under", "set_a/*").load(folder)

The driver lists `depth` levels of subfolders only, 2 if not said (set and task); each of them is a partition, whose task lists what is
below it. Subfolders that don't match `under` are not entered at all. A folder that isn't there has no files; a file is listed alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from fnmatch import fnmatchcase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Subfolder(InputPartition):
    """A subfolder (path below the root, "" for the root itself) and whether what is below its own files is another partition's."""

    def __init__(self, name: str, flat: bool):
        super().__init__((name, flat))
        self.name, self.flat = name, flat


class ListingReader(DataSourceReader):
    def __init__(self, uri: str, glob: str, under: str, depth: int):
        self.uri, self.glob, self.under, self.depth = uri, glob, under.strip("/"), depth

    def _open(self) -> tuple:
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri if "://" in self.uri else f"file://{self.uri}")

    def _fits(self, name: str) -> bool:
        """Whether a subfolder may have matching ones below it, or is one: parts are compared as far as both have them."""
        return all(fnmatchcase(a, b) for a, b in zip(name.split("/"), self.under.split("/"))) if self.under else True

    def partitions(self) -> list[Subfolder]:
        from pyarrow import fs

        store, root = self._open()
        if store.get_file_info(root).type == fs.FileType.File:
            return [Subfolder("", True)]
        found, level = [], [""]
        for _ in range(self.depth):
            deeper = []
            for name in level:
                # Files beside subfolders belong to their own partition.
                found.append(Subfolder(name, True))
                below = store.get_file_info(fs.FileSelector(f"{root}/{name}" if name else root, allow_not_found=True))
                deeper += [f"{name}/{f.base_name}".lstrip("/") for f in below if f.type == fs.FileType.Directory]
            level = [name for name in sorted(deeper) if self._fits(name)]
        return found + [Subfolder(name, False) for name in level]

    def read(self, partition: Subfolder) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = self._open()
        start = f"{root}/{partition.name}" if partition.name else root
        whole = store.get_file_info(root)
        for f in [whole] if whole.type == fs.FileType.File else store.get_file_info(fs.FileSelector(start, recursive=not partition.flat, allow_not_found=True)):
            folder = f.path[len(root) :].strip("/").rpartition("/")[0]
            inside = not self.under or (len(folder.split("/")) >= len(self.under.split("/")) and self._fits(folder))
            if f.type == fs.FileType.File and fnmatchcase(f.base_name, self.glob) and inside:
                yield f.path, f.size, folder


class FileListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, size bigint, folder string"

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options["path"].rstrip("/"), self.options.get("glob", "*"), self.options.get("under", ""), int(self.options.get("depth", "2")))


def plain_path(path: Column) -> Column:
    """A path as listings have it: without scheme and authority."""
    return F.regexp_replace(F.regexp_replace(path, "^file:/+", "/"), "^[a-z][a-z0-9+.-]*://[^/]*", "")


def listed(spark: SparkSession, path: str, glob: str = "*", under: str = "", depth: int = 2) -> DataFrame:
    """(path, size, folder) of the files below path whose name matches glob and whose subfolders match under."""
    spark.dataSource.register(FileListing)
    return spark.read.format("file_listing").option("glob", glob).option("under", under).option("depth", str(depth)).load(path)
