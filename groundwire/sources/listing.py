"""A tree of files as a data source: folders are its partitions, and ignored ones are never opened."""

from __future__ import annotations

import fnmatch
from collections import deque

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import IGNORED_DIRS

SCHEMA = "path string, size long, modified timestamp, text string"


class Folder(InputPartition):
    """One folder: with all that lies below it, or its own files alone."""

    def __init__(self, path: str, deep: bool):
        super().__init__((path, deep))
        self.path, self.deep = path, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.include = [x for x in options.get("include", "").split(",") if x]
        self.ignored = {*IGNORED_DIRS, *(x for x in options.get("exclude", "").split(",") if x)}
        self.max_bytes = int(options.get("maxbytes", 4_000_000))
        self.parts = int(options.get("numpartitions", 64))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.root if "://" in self.root or not self.root.startswith("/") else f"file://{self.root}")

    def _entries(self, store: fs.FileSystem, folder: str) -> tuple[list, list]:
        """Files and folders directly in a folder, without ignored ones and links out of the tree."""
        seen = sorted(store.get_file_info(fs.FileSelector(folder)), key=lambda x: x.path)
        files = [x for x in seen if x.type == fs.FileType.File]
        folders = [x for x in seen if x.type == fs.FileType.Directory and x.base_name not in self.ignored and not x.base_name.endswith(".egg-info") and not self._is_link(store, x.path)]
        return files, folders

    @staticmethod
    def _is_link(store: fs.FileSystem, path: str) -> bool:
        import os

        return store.type_name == "local" and os.path.islink(path)

    def partitions(self) -> list[Folder]:
        """Folders from the root down, until there are enough of them to share."""
        store, root = self._open()
        shallow, open_ = [], deque([root])
        while open_ and len(open_) + len(shallow) < self.parts:
            folder = open_.popleft()
            shallow.append(Folder(folder, False))
            open_ += [x.path for x in self._entries(store, folder)[1]]
        return shallow + [Folder(x, True) for x in open_]

    def read(self, partition: Folder):
        store, root = self._open()
        open_ = [partition.path]
        while open_:
            files, folders = self._entries(store, open_.pop())
            if partition.deep:
                open_ += [x.path for x in folders]
            for x in files:
                path = x.path[len(root.rstrip("/")) + 1 :]
                if self._is_link(store, x.path) or self.include and not any(fnmatch.fnmatch(path, p) or fnmatch.fnmatch(x.base_name, p) for p in self.include):
                    continue
                text = None
                if x.size <= self.max_bytes:
                    with store.open_input_stream(x.path) as stream:
                        raw = stream.read()
                    text = None if b"\0" in raw else raw.decode("utf-8", "replace")
                yield path, x.size, x.mtime, text


class TreeSource(DataSource):
    """`tree`: path, size, modified and text of all files below a folder of any file system that Arrow reads.

    Options: path; include (patterns of paths or names, with commas), exclude (more names of folders to leave out), maxBytes (larger
    files have a null text, as have those with a NUL), numPartitions.  Links are not followed.
    """

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader({k.lower(): v for k, v in self.options.items()})


def read_tree(spark: SparkSession, root: str, include: str = "", exclude: str = "", max_bytes: int = 4_000_000, partitions: int = 64) -> DataFrame:
    """(path, size, modified, text) of a tree, read folder by folder on the executors."""
    from ..runtime import ship

    ship(spark)
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").options(path=root, include=include, exclude=exclude, maxBytes=max_bytes, numPartitions=partitions).load()
