"""Making the library importable in Python workers, and folders for what jobs write between their stages."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()

#: Rows of an Arrow batch of whole texts; the default of 10,000 takes hundreds of MB outside the heap for each task.
BATCH_ROWS = 1000
#: Bytes that an Arrow batch takes; a single row may be longer.
BATCH_BYTES = 16 << 20


def bound_batches(df: DataFrame) -> DataFrame:
    """df, with its session's Arrow batches bounded in rows and bytes; called by the operators that give texts to Python.

    The settings stay, as plans read them when they run; they bound memory and change no result.
    """
    conf, rows, size = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(conf.get(rows)) <= BATCH_ROWS:
        conf.set(rows, str(BATCH_ROWS))
        conf.set(size, f"{BATCH_BYTES}b")
    return df


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="ship-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for path in root.rglob("*.py"):
            archive.write(path, path.relative_to(root.parent))
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which the driver and all executors share.

    Where that is unset, a local master (tests) gets a temporary folder; a cluster has none that all machines see.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.gettempdir() + "/checkpoints"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def temporary(spark: SparkSession, path: str) -> None:
    """Have a written folder removed when the application ends; results that read it are good until then."""
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(folder)
