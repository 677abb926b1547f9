"""Tables in the folder that the whole cluster shares, and groups of documents of bounded size."""

from __future__ import annotations

import atexit
import shutil
import sys
import tempfile
import threading
import types
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset on a local master (tests), a temporary folder that goes with the process.  On a cluster it must be set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        folder = tempfile.mkdtemp(prefix="pairtide-")
        atexit.register(shutil.rmtree, folder, True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: later jobs read it, and no lost executor can take it along."""
    path = new_path(df.sparkSession, name)
    _paths.append(path)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Tables of this process that were written and not removed.
_paths: list[str] = []


@contextmanager
def passing(spark: SparkSession):
    """Removes the tables written inside the block at its end, when all results that read them must have been written."""
    start = len(_paths)
    try:
        yield
    finally:
        for path in _paths[start:]:
            remove(spark, path)
        del _paths[start:]


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def kept(name: str, make):
    """A value made once a worker process.  Functions are pickled by value, so what a module's own variables hold would be made anew in each task."""
    store = sys.modules.setdefault("pairtide_kept", types.ModuleType("pairtide_kept"))
    if name not in vars(store):
        setattr(store, name, make())
    return getattr(store, name)


def give_back() -> None:
    """Hands what Arrow has freed back to the system.  A worker lives through many stages; else it keeps the most that Arrow ever took in one of them."""
    pa.default_memory_pool().release_unused()


def tidy(run):
    """``run``, a function for ``mapInArrow``, that gives memory back at the end of a task, when its own variables have gone."""

    def task(batches):
        yield from run(batches)
        give_back()

    return task


#: Seconds after which a worker gives up what it was lent: longer than a worker waits for its next task of a stage, shorter than the stages that follow.
IDLE = 15.0


@contextmanager
def lent(name: str, make, idle: float | None = None):
    """A value made once a worker process as in :func:`kept`, for large ones: a worker that has not used it for ``idle`` seconds (``IDLE``) gives it up, so it does not take memory from later stages."""
    store = vars(kept("lent", lambda: types.SimpleNamespace(values={}, timers={})))
    timer = store["timers"].pop(name, None)
    if timer:
        timer.cancel()
    value = store["values"].get(name)
    if value is None:
        value = make()
    store["values"][name] = value

    def give_up():
        store["values"].pop(name, None)
        give_back()

    try:
        yield value
    finally:
        timer = store["timers"][name] = threading.Timer(IDLE if idle is None else idle, give_up)
        timer.daemon = True
        timer.start()


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


def grouped(docs: DataFrame, total_bytes: int, group_bytes: int = 8 << 20, key: str = "doc_id", least: int = 32) -> DataFrame:
    """``docs`` with ``gid``: groups by a hash of the key, of about ``group_bytes`` of text each, ``least`` groups at least.

    Rows with equal keys share a group, rows with a null key are dealt by their text; texts of any frequency spread over all groups."""
    n = max(least, -(-total_bytes // group_bytes))
    dealt = F.when(F.col(key).isNull(), F.xxhash64("text", F.lit(8))).otherwise(F.xxhash64(key, F.lit(7)))
    return docs.withColumn("gid", F.pmod(dealt, F.lit(n)).cast("int"))
