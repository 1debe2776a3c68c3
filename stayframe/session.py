"""Session set-up for local runs and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}


def local_session(app: str = "stayframe", cores: str = "*", partitions: int = 8, memory: str = "8g"):
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        # As many partitions as cores already; merging small ones would leave cores idle.
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as the session names it in ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own; on a cluster the
    setting is required, because a machine-local folder is lost with its machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_folders:
        _own_folders[app] = tempfile.mkdtemp(prefix="stayframe-")
    return _own_folders[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result outlives the executors that made it."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


# Bytes of rows that a task reads, or sends to Python, at once from a session of ``bounded_session``.
BATCH_BYTES = 32 * 1024 * 1024
_BATCHES = ("spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")


def bounded_session(spark: SparkSession, row_bytes: int, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """A session with the settings of ``spark``, but with no more rows in a batch than ``batch_bytes`` hold.

    Spark counts the rows of a batch and not their bytes, so rows of tens of kilobytes make batches of hundreds of megabytes,
    for every task several at a time. The settings of ``spark`` itself stay as they are.
    """
    apart = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if apart.conf.isModifiable(key):
            apart.conf.set(key, value)
    most = max(1, batch_bytes // max(1, row_bytes))
    for key in _BATCHES:
        have = int(spark.conf.get(key))
        apart.conf.set(key, str(min(have, most) if have > 0 else most))
    return apart
