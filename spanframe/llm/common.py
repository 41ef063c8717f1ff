"""Helpers shared by the corpus operators: scratch tables, bounded batches, checked broadcasts."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a few numbers and digests may be broadcast once it has been counted.
BROADCAST_ROWS = 100_000
#: `[\x20\x09-\x0D]`, the white space of the text contracts.
SPACE = " \t\n\x0b\x0c\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests, local mode), one of our own, removed at exit."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root is None:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _OWN.get("dir")
        if root is None:
            root = _OWN["dir"] = tempfile.mkdtemp(prefix="spanframe-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return root.rstrip("/")


_OWN: dict[str, str] = {}


class Scratch:
    """Intermediate tables in the shared folder: they cut lineage and survive lost executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/spanframe/{name}-{uuid.uuid4().hex[:12]}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name))
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


_HELD: dict = {}


def release() -> None:
    """Give memory that nothing uses any more back to the system: an idle worker keeps its process, not its garbage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library has no such function, and needs none
        ctypes.CDLL(None).malloc_trim(0)


def release_driver(spark: SparkSession) -> bool:
    """release() in the driver, in its JVM too: its heap shrinks, and native memory that its threads have freed goes back.

    The latter is a command of JVMs on glibc; True if this one has it, else that memory stays with the JVM.
    """
    release()
    jvm = spark.sparkContext._jvm
    jvm.System.gc()
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    arguments = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
    arguments[0], arguments[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    # the server's class is not open to reflection, its interface is
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(server, arguments)
    except Py4JJavaError:
        return False
    return True


def kept_by_worker(key: object, make):
    """What make() gives, kept by this worker process for tasks of the same key; another key's is let go first."""
    if key not in _HELD:
        _HELD.clear()
        release()
        _HELD[key] = make()
        release()
    return _HELD[key]


#: Rows and bytes of the Arrow batches that corpus operators send to Python.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches within BATCH_ROWS and BATCH_BYTES, which a JVM and a Python worker both need memory for.

    Frames are planned when they run, so this is a setting of the session. It is the same for all operators and is only ever
    lowered, so neither the order in which frames are made nor a lower limit of the user's own is affected.
    """
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = int(str(spark.conf.get(f"spark.sql.execution.arrow.{key}")).rstrip("bB"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def portions(batches: Iterable[pa.RecordBatch], text: int, rows: int = 1000, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most so many rows, and bytes of the column `text`, so that few texts are objects at once.

    bounded_batches() bounds an Arrow batch; what Python makes of it is bounded here. A single longer text is a slice alone.
    """
    for b in batches:
        ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(b.column(text)), 0), np.int64))
        start, before = 0, 0
        while start < b.num_rows:
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, before + size, side="right"))))
            yield b.slice(start, stop - start)
            start, before = stop, int(ends[stop - 1])
    release()


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it has at most BROADCAST_ROWS rows, else df as it is (a shuffle join, split by AQE)."""
    n = df.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str = "text") -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def training_row(doc_id: str = "doc_id") -> Column:
    """True for rows that a classifier may learn from; the others are held out."""
    return ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of doc_id as text, mod 5, is 0; a null id counts as the text of none: held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


#: A group of at least 1 / HOT of all rows is hot, so there are at most HOT hot groups.
HOT = 1000


def by_hot_key(rows: DataFrame, answers: DataFrame, key: str, n_rows: int) -> DataFrame:
    """rows joined to the one answer of their key. answers.rows is how many rows have the key.

    Hot keys, at most HOT of them, are broadcast; in the shuffle that joins the others no key has over 1 / HOT of all rows.
    """
    is_hot = F.col("rows") >= F.greatest(F.lit(2), F.lit(n_rows // HOT + 1))
    columns = [*rows.columns, *[c for c in answers.columns if c not in (key, "rows")]]
    marked = rows.join(F.broadcast(answers.where(is_hot).drop("rows").withColumn("hot", F.lit(True))), key, "left")
    cold = marked.where("hot is null").select(*rows.columns).join(answers.where(~is_hot).drop("rows"), key)
    return marked.where("hot").select(*columns).unionByName(cold.select(*columns))
