"""Written tables in the folder that driver and executors share.

The folder is the cluster's ``spark.checkpoint.dir``. Only where a session names none (tests, a
single machine) is one made. Tables stay until ``release`` or the end of the Python process, as a
lazy result may still read them.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
            own = tempfile.mkdtemp(prefix="termloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            spark.sparkContext.setCheckpointDir(own)
        base = jsc.getCheckpointDir().get()
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/termloom-{name}-{fresh()}"
    _written.append(path)
    return path


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: the lineage ends there."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def fresh() -> str:
    return uuid.uuid4().hex


def adopt(path: str) -> None:
    """Delete ``path`` too at the end."""
    _written.append(path)


def mark() -> int:
    """How many tables are staged so far, for ``discard``."""
    return len(_written)


def discard(spark: SparkSession, first: int, last: int) -> None:
    """Delete the tables staged between two marks; their places in the list stay."""
    for k in range(first, min(last, len(_written))):
        if _written[k]:
            delete(spark, _written[k])
            _written[k] = ""


def release(spark: SparkSession) -> None:
    """Delete every table staged so far. Only for callers whose results are written elsewhere."""
    while _written:
        path = _written.pop()
        if path:
            delete(spark, path)


@atexit.register
def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            release(spark)
        except Exception:  # noqa: BLE001  the JVM may be gone
            pass
