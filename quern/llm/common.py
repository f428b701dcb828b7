"""What the operators of this subpackage share: tables in the shared folder, keys, batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Stands for a null id, so that null counts as the smallest id.
NULL_ID = -(2**63)


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir.  On a single machine a temporary one, set for later calls, where it is unset; on a cluster that is an error."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        conf = "file://" + tempfile.mkdtemp(prefix="quern-")
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{uuid.uuid4().hex}/{name}"


#: Spark's own setting: shuffle files go as soon as the query that made them has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writes, _before = threading.Lock(), Counter(), {}


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """While writes go on here, a query's shuffle files go when it has ended; the first write sets that and the last one takes it back."""
    key = id(spark)
    with _lock:
        if not _writes[key]:
            _before[key] = spark.conf.get(CLEANUP, None)
            spark.conf.set(CLEANUP, "true")
        _writes[key] += 1
    try:
        yield
    finally:
        with _lock:
            _writes[key] -= 1
            if not _writes[key]:
                before = _before.pop(key)
                spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with cleaned(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that :func:`table` wrote; nothing may read them any more."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces_of(df: DataFrame, text: str, size: int) -> int:
    """How many pieces of about ``size`` bytes of ``text`` there are, and a piece for each shuffle partition at least."""
    total = df.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    return max(partitions(df.sparkSession), -(-total // size))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` hasn't, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def id_key(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(NULL_ID)).cast("long")


def text_key(col: Column | str) -> Column:
    return F.xxhash64(F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit("")))


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(batch: pa.RecordBatch, name: str) -> list[str]:
    """A string column's values; null becomes the empty text."""
    return ["" if x is None else x for x in batch.column(name).to_pylist()]


def give_back() -> None:
    """Return freed memory to the system, so that a worker's next task, of another kind, doesn't come on top of it."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives its freed memory back."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return each


def sliced(batches: Iterator[pa.RecordBatch], name: str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``most`` bytes of column ``name``, a row at least."""
    for batch in batches:
        sizes = pa.compute.binary_length(batch.column(name)).fill_null(0).to_pylist()
        begin, total = 0, 0
        for i, n in enumerate(sizes):
            if total and total + n > most:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += n
        if begin < len(sizes):
            yield batch.slice(begin)
