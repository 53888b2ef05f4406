"""Helpers shared by the training-data operators: shared storage, names of helper columns, and workers' caches."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach.

    It is the session's ``spark.checkpoint.dir``. Only a local session (one machine, as in tests) that
    leaves it unset gets a temporary folder; on a cluster a missing setting is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chronolith-")
        _own_dir[spark.sparkContext.applicationId] = found
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(found)
    return found


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/chronolith/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: cuts lineage, survives lost executors."""
    path = work_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_work_files(spark: SparkSession) -> bool:
    """Deletes what the operators wrote to the shared folder. Results that were not yet read or written elsewhere are lost."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/chronolith")
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, lengthened until no column has them: for helper columns beside the caller's own."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


_caches: dict[str, list[dict]] = {}  # of this process, by operator
_using: dict = {"task": None, "now": set(), "before": set()}  # the operators that this task and the one before have used


def worker_cache(operator: str, cache: dict) -> dict:
    """Lets :func:`using` empty ``cache``, which a worker process keeps from task to task."""
    _caches.setdefault(operator, []).append(cache)
    return cache


def _task() -> int | None:
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


def using(operator: str) -> None:
    """Called in a task before it uses an operator's caches. Spark hands worker processes on from one query to the next:
    caches of operators that neither this task nor the process's task before it uses are emptied, so that a pipeline's
    workers do not hold those of all its stages. Outside of tasks nothing is emptied."""
    task = _task()
    if task is None:
        return
    if task != _using["task"]:
        _using.update(task=task, now=set(), before=_using["now"])
    if operator in _using["now"]:
        return
    _using["now"].add(operator)
    for other in _caches.keys() - _using["now"] - _using["before"]:
        for cache in _caches[other]:
            cache.clear()
    release_memory()


def release_memory() -> None:
    """Gives back to the machine what this process has freed; allocators keep it, and the executor's other processes lack it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None  # glibc's
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
