"""Session settings and lineage cutting."""
from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STAGE_KEY = "spark.checkpoint.dir"
#: Shuffle files of a query go when it ends; else they stay until the driver happens to collect its garbage.
CLEANUP_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def build_session(cores: str = "*", app: str = "hiemal") -> SparkSession:
    """A local session with the settings the library is tested under."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", os.environ.get("HIEMAL_SHUFFLE", "8"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )


def stage_folder(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir`` of the session.

    Where it is unset, a local master gets a folder of the application that goes when Python ends; on a cluster
    that is an error, as executors and driver would not see the same files.
    """
    named = spark.conf.get(STAGE_KEY, None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError(f"set {STAGE_KEY} to a folder that the driver and all executors share")
    folder = f"{sc._jvm.System.getProperty('java.io.tmpdir')}/spark-stages-{sc.applicationId}"
    if not os.path.isdir(folder):
        os.makedirs(folder)
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(stage_folder(df.sparkSession))
    return df.checkpoint(eager=True)


#: Tables staged in each ``passing_tables`` that is open, innermost last.
_passing: list[list[str]] = []


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables staged inside go at the end, so that a long chain of steps doesn't hold them all on disk.

    Yields a ``stage_table`` whose tables stay: whatever is read after the end has to be staged with it.
    """
    here: list[str] = []
    _passing.append(here)

    def keep(df: DataFrame) -> DataFrame:
        out = stage_table(df)
        path = here.pop()
        if len(_passing) > 1:
            _passing[-2].append(path)
        return out

    try:
        yield keep
    finally:
        _passing.pop()
        for path in here:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(folder, True)


def stage_table(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: smaller than a checkpoint, read by column.

    The shuffle files of the write are freed with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark)}/tables/{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP_KEY)
    spark.conf.set(CLEANUP_KEY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP_KEY, before)
    if _passing:
        _passing[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)
