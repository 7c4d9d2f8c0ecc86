"""A data source for trees of files: directories are planned on the driver by name, files are listed further and read by the tasks, hidden ones too."""

from __future__ import annotations

import fnmatch
import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from schemasight.registry import SKIP_DIRS

#: Stores that tasks open without the JVM; the setting schemasight.tree.stores names others that pyarrow reaches on all machines.
STORES = "file,s3,gs"
#: Directories are listed by the driver until there are so many, and so many files of a listed one go to a task.
DIRECTORIES, FILES = 256, 1000


def is_hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def is_wanted(name: str, names: list[str], endings: list[str]) -> bool:
    """Whether a name matches a pattern or ends, in any case, with an ending."""
    return any(fnmatch.fnmatchcase(name, p) for p in names) or name.lower().endswith(tuple(e.lower() for e in endings))


@dataclass
class Part(InputPartition):
    """Files of one directory, or (files is None) all below it; skipped: within a directory that scans leave out."""

    root: int
    path: str
    skipped: bool
    files: list[str] | None = None


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.names = json.loads(options.get("names", "[]"))
        self.endings = json.loads(options.get("endings", "[]"))
        self.opened = options.get("opened", "true") == "true"

    @staticmethod
    def store(root: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(root)

    def listed(self, store, part: Part) -> tuple[list[Part], list[str]]:
        """The directories and the wanted files in a directory. Hidden directories that scans leave out are not entered, nor
        is what is hidden in others that they leave out."""
        from pyarrow import fs

        directories, files = [], []
        for found in store.get_file_info(fs.FileSelector(part.path)):
            name = found.base_name
            if part.skipped and is_hidden(name):
                continue
            if found.type == fs.FileType.Directory:
                if not (name in SKIP_DIRS and is_hidden(name)):
                    directories.append(Part(part.root, found.path, part.skipped or name in SKIP_DIRS))
            elif found.type == fs.FileType.File and is_wanted(name, self.names, self.endings):
                files.append(name)
        return directories, files

    def partitions(self) -> list[Part]:
        from pyarrow import fs

        todo, out = [], []
        for root, (_, uri) in enumerate(self.roots):
            store, path = self.store(uri)
            kind = store.get_file_info(path).type
            if kind == fs.FileType.NotFound:
                raise FileNotFoundError(uri)
            if kind == fs.FileType.File:
                out.append(Part(root, path.rpartition("/")[0], False, [path.rpartition("/")[2]]))
            else:
                todo.append(Part(root, path, False))
        while todo and len(todo) < DIRECTORIES:
            again = []
            for part in todo:
                directories, files = self.listed(self.store(self.roots[part.root][1])[0], part)
                again += directories
                out += [Part(part.root, part.path, part.skipped, files[k : k + FILES]) for k in range(0, len(files), FILES)]
            todo = again
        return out + todo or [Part(0, "", False, [])]

    def read(self, part: Part) -> Iterator[tuple]:
        if part.files == []:
            return
        given, uri = self.roots[part.root]
        store, base = self.store(uri)
        base = base.rstrip("/") + "/"
        todo = [part]
        while todo:
            directory = todo.pop()
            if directory.files is None:
                below, files = self.listed(store, directory)
                todo += below
            else:
                files = directory.files
            for name in files:
                path = f"{directory.path.rstrip('/')}/{name}"
                yield given, path.removeprefix(base) if path.startswith(base) else name, name, self.content(store, path) if self.opened else None

    @staticmethod
    def content(store, path: str) -> bytes:
        with store.open_input_stream(path) as stream:
            return stream.read()


class Tree(DataSource):
    """Rows (root, path below it, name, content) of the files whose name matches one of ``names`` or ends, in any case, with one of ``endings``."""

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return "root string, path string, name string, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def qualified(spark: SparkSession, root: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return "file://" + found.removeprefix("file:") if found.startswith("file:/") and not found.startswith("file://") else found


def can_open(spark: SparkSession, roots: list[str]) -> bool:
    """Whether tasks can open the stores of all these qualified roots."""
    return {r.split(":")[0] for r in roots} <= set(spark.conf.get("schemasight.tree.stores", STORES).split(","))


def read_tree(spark: SparkSession, roots: list[tuple[str, str]], names: list[str], endings: list[str], opened: bool = True) -> DataFrame:
    """One read of all roots (as given, with their qualified names), whatever their number; a file below two of them has a row for each."""
    spark.dataSource.register(Tree)
    return spark.read.format("file_tree").options(roots=json.dumps(roots), names=json.dumps(names), endings=json.dumps(endings), opened=opened).load()
