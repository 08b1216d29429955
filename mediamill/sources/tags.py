"""A data source of metadata tags that reads only the parts of files that hold them.

``spark.read.format("mediatags").load("/folder/*.wav")`` gives a row for each tag.  A
partition is a group of files; a file's samples are never read, so a master of gigabytes
costs a few seeks.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..errors import MediaError
from ..kernels import skim

SCHEMA = "file string, pos int, tag_group string, name string, kind string, i bigint, r double, s string, l array<string>, error string"


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class TagReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options.get("path", "")
        self.per = int(options.get("filesPerPartition", "64"))

    def _listed(self) -> list[str]:
        path = self.path
        if "://" in path:
            from pyarrow import fs

            store, inner = fs.FileSystem.from_uri(path)
            info = store.get_file_info(inner)
            if info.type == fs.FileType.File:
                return [path]
            prefix = path[: len(path) - len(inner)]
            return sorted(prefix + f.path for f in store.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File)
        if os.path.isdir(path):
            return sorted(p for p in glob.glob(os.path.join(path, "**"), recursive=True) if os.path.isfile(p))
        return sorted(glob.glob(path))

    def partitions(self) -> list[Files]:
        paths = self._listed()
        return [Files(paths[i : i + self.per]) for i in range(0, len(paths), self.per)] or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        for path in partition.paths:
            try:
                with _opened(path) as f:
                    tags = skim.read(f).tags
            except MediaError as e:
                yield path, None, None, None, None, None, None, None, None, f"{e.kind}: {e}"
                continue
            for t in tags:
                yield path, *t.values(), None


def _opened(path: str):
    if "://" in path:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(path)
        return store.open_input_file(inner)
    return open(path, "rb")


class TagSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mediatags"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return TagReader(self.options)


def register(spark) -> None:
    spark.dataSource.register(TagSource)
