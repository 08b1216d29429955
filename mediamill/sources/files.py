"""Files as rows, in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_media(spark: SparkSession, path: str, glob: str | None = None, most_bytes: int | None = None) -> DataFrame:
    """``path, modificationTime, length, content`` of files; a bound on their length reaches the scan, so larger files aren't opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    df = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    return df.where(df["length"] <= most_bytes) if most_bytes else df


class _Done(WriterCommitMessage):
    def __init__(self, files: int):
        self.files = files


class FileWriter(DataSourceWriter):
    """Each row's bytes to a file of its name below a folder: whole, under another name first."""

    def __init__(self, options: dict[str, str]):
        self.folder = options["path"]

    def write(self, iterator) -> WriterCommitMessage:
        import uuid

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        n = 0
        for row in iterator:
            name = str(row["name"])
            if name.startswith("/") or ".." in name.split("/"):
                raise ValueError("a file's name may not leave the folder")
            path = f"{root}/{name}"
            store.create_dir(path.rsplit("/", 1)[0], recursive=True)
            half = f"{path}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(half) as out:
                out.write(bytes(row["content"]))
            store.move(half, path)
            n += 1
        return _Done(n)


class FileSink(DataSource):
    """``df.select("name", "content").write.format("mediafiles").mode("append").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "mediafiles"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return FileWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileSink)
