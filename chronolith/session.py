"""Session defaults: UTC, adaptive execution, explicit parallelism."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

_own_dir: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach: the session's ``spark.checkpoint.dir``.

    Only a local session (one machine, as in tests) that leaves it unset gets a temporary folder; on a cluster a
    missing setting is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _own_dir.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own_dir[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="chronolith-")
    return found


def work_path(spark: SparkSession, label: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/chronolith/{label}-{uuid.uuid4().hex}"


def build_session(master: str | None = None, shuffle_partitions: int | None = None, app: str = "chronolith") -> SparkSession:
    """A session with the settings that the operators expect; unset arguments keep the cluster's own."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    return b.getOrCreate()
