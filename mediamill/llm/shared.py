"""Places and small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
import tempfile
import uuid
import weakref
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset and the master is local, as in tests on one machine, a temporary
    folder is made and set; a cluster must name one, as its machines share no temporary folder.
    """
    here = spark.conf.get("spark.checkpoint.dir", None)
    if not here:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        here = jvm.get() if jvm.isDefined() else None
    if not here:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        here = "file://" + tempfile.mkdtemp(prefix="mediamill-shared-")
        spark.conf.set("spark.checkpoint.dir", here)
    return here.rstrip("/")


def _home(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/mediamill/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below this session's part of the shared folder."""
    return f"{_home(spark)}/{name}-{uuid.uuid4().hex}"


_places: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()
#: Set while a scratch table is written: shuffle files go with the execution, and batches for Python are smaller, as
#: a task holds one on either side.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage and is computed once.

    The shuffle files behind it are deleted when it is written, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = {k: spark.conf.get(k) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _places[out] = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` gave, once everything made of them is written itself."""
    for t in tables:
        if path := _places.pop(t, None):
            _delete(t.sparkSession, path)


def _delete(spark: SparkSession, where: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear_scratch(spark: SparkSession) -> bool:
    """Delete this session's scratch tables in the shared folder; results that are still to be computed from them are lost."""
    return _delete(spark, _home(spark))


_caches: dict[str, dict] = {}


def worker_cache(owner: str) -> dict:
    """What an operator keeps in this Python worker from task to task; what another one kept goes, and its memory with it."""
    if owner not in _caches:
        for kept in _caches.values():
            kept.clear()
        _caches.clear()
        trim()
        _caches[owner] = {}
    return _caches[owner]


def trim() -> None:
    """Give freed memory back to the machine: workers live on from task to task."""
    gc.collect()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: freed memory stays with the process


def lean(owner: str) -> Callable:
    """A function over Arrow batches that begins without other operators' caches and gives its memory back at its end."""

    def wrap(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker_cache(owner)
            yield from work(batches)
            trim()

        return run

    return wrap


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The two columns that an operator reads, whatever others the table has."""
    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def heavy_hitters(docs: DataFrame, split: Callable[[str], list[str]], most: int, per_task: int = 16384, held: int = 200_000) -> list[tuple[str, int]]:
    """The ``most`` commonest tokens over every text, by bounded summaries.

    Each task counts with a table of at most ``held`` tokens (the rarer half goes when it
    is full, as in lossy counting) and gives its ``per_task`` commonest; only these
    summaries are shuffled, added up and cut to ``most``.  So the rows moved follow the
    number of tasks and never the number of tokens.  The counts are lower bounds: the
    result is good for choosing what to keep in a fast table, not as statistics.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if t:
                    seen.update(split(t))
                    if len(seen) > held:
                        seen = Counter(dict(seen.most_common(held // 2)))
        top = seen.most_common(per_task)
        yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in top], pa.string()), pa.array([n for _, n in top], pa.int64())], ["w", "n"])

    rows = docs.select("text").mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "w").limit(most).collect()
    return [(r.w, r.n) for r in rows]
