"""What the operators share: settings, shared scratch tables, table loading."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def tune(spark: SparkSession, batch_mb: int = 4, batch_rows: int = 4000) -> None:
    """Bound the Arrow batches that Python workers hold, in bytes and in rows.

    The session's own bounds are lowered only, never raised: results are lazy, so they must still hold when the caller
    runs them. A caller who needs others back sets them after that.
    """
    for key, unit, most in (("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20, batch_mb << 20), ("spark.sql.execution.arrow.maxRecordsPerBatch", 1, batch_rows)):
        now = spark.conf.get(key, None) or "0"
        number = re.match(r"\s*(\d+)\s*([kmg]?)b?\s*$", now.lower())
        size = int(number[1]) * {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30}[number[2]] if number else 0
        if not 0 < size <= most:
            spark.conf.set(key, f"{most // unit}{'m' if unit > 1 else ''}")


def release() -> None:
    """Free what an operator before has left in this Python worker: called at the start of others' tasks.

    Spark keeps workers over stages. Freed memory in small pieces stays with the process unless the C library is asked
    to give it back, where it can.
    """
    bpe = sys.modules.get(f"{__package__}.bpe")
    if bpe is not None and bpe.coder.cache_info().currsize:
        bpe.coder.cache_clear()
        gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Only where it is unset and everything runs on this machine (tests, trials) a new temporary one is made.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="cinderframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is deleted at the session's end, if ``forget`` does not do so before."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    files.mkdirs(place.getParent())
    files.mkdirs(place)
    files.deleteOnExit(place)
    return path


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The lineage ends at the written files, which every executor sees, so the loss of an
    executor repeats no earlier stage. Shuffle files of the write are freed at its end.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    before = spark.conf.get(CLEAN_UP, None)
    spark.conf.set(CLEAN_UP, "true")
    try:
        df.write.mode("overwrite").parquet(path)
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(CLEAN_UP, before) if before is not None else spark.conf.unset(CLEAN_UP)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``cut`` that nothing reads any more."""
    for df in tables:
        forget_folders(df.sparkSession, *{f.rpartition("/")[0] for f in df.inputFiles()})


def forget_folders(spark: SparkSession, *folders: str) -> None:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names, cast; other columns stay behind.

    only(df, doc_id="long", text="string") keeps clashing or extra columns out of joins.
    """
    return df.select(*(F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()))


def unused(name: str, taken: list[str]) -> str:
    """A column name that no other has, in any case."""
    lower = {c.lower() for c in taken}
    while name.lower() in lower:
        name += "_"
    return name


def tasks(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
