"""Session helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cpus: int = 8, shuffle_partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """df, persisted until release(): for tables that one query reads several times."""
    _held.append(df.persist())
    return df


def release() -> None:
    """Unpersists what was held. What is still to be read is then computed again."""
    while _held:
        _held.pop().unpersist()


_temporary: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, one temporary folder on a local master (tests); a cluster must name it."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _temporary:
            _temporary.append(tempfile.mkdtemp(prefix="doclens-"))
        found = _temporary[0]
    return found


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back: lineage ends here, and what is read survives lost executors."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def import_path(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver found it. A cluster may ship it with --py-files instead."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


#: Bytes of an Arrow batch that goes to a Python worker, at most (or one row).
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """For stages whose rows are large. To be called before the stage is planned; it holds for the session, and changes no results."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def give_back() -> None:
    """Returns freed memory to the system, at the end of a Python worker's task: workers live on while others run."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries have it
        ctypes.CDLL(None).malloc_trim(0)
