"""Session and checkpoint set-up."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


#: Rows in a batch that goes to Python.
BATCH_ROWS = 1000


def tune(spark: SparkSession) -> SparkSession:
    """Set the run-time options every job relies on (safe to repeat)."""
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    # a worker holds a batch of whole pages and all their elements
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  memory: str | None = None) -> SparkSession:
    """A session for scripts and tests; on a cluster use the one you are given."""
    builder = SparkSession.builder.appName("vacantis").config("spark.ui.enabled", "false")
    # rule tables make large expressions; recording a call site for each part of
    # them is most of the time it takes to build a plan (fixed at session start)
    builder = builder.config("spark.python.sql.dataFrameDebugging.enabled", "false")
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    return tune(builder.getOrCreate())


_LOCAL_FOLDERS: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that all executors share, for checkpoints and intermediate tables.

    It is the one named by ``spark.checkpoint.dir``.  Where the session has
    none, a local session (tests) gets a temporary one and a cluster is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        # the setting is fixed at start, so the folder is remembered here
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_FOLDERS:
            _LOCAL_FOLDERS[app] = tempfile.mkdtemp(prefix="vacantis-")
        shared = _LOCAL_FOLDERS[app]
    return shared


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"
