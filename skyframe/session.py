"""Session helpers: table access and lineage cuts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


CLEAN = "spark.cleaner.referenceTracking.cleanCheckpoints"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One parquet table of a data folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all machines share: what the session names in ``spark.checkpoint.dir``. Only on a single machine, where it
    may be unset, a temporary one, removed at the end."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    folder = tempfile.mkdtemp(prefix="skyframe-checkpoint-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with checkpoint() and return it with its lineage cut.

    The copy lives in the shared folder, so losing an executor loses nothing. Spark deletes it once nothing refers to it any
    more, unless the session says spark.cleaner.referenceTracking.cleanCheckpoints = false.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    if context.getConf().get(CLEAN) is None:
        context._jsc.sc().conf().set(CLEAN, "true")  # read whenever a copy is made
    return df.checkpoint(eager=True)


def small(df: DataFrame, most: int = 100_000) -> DataFrame:
    """``df``, to be joined to something large: broadcast if it has at most ``most`` rows, else materialised and joined as
    Spark sees fit. At most ``most`` + 1 rows come to the driver."""
    rows = df.limit(most + 1).toArrow()
    if rows.num_rows <= most:
        return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
    return cut(df)


def null_safe(left: DataFrame, right: DataFrame, names: list[str]):
    """Join condition ``left.n <=> right.n`` for every name."""
    condition = None
    for name in names:
        one = left[name].eqNullSafe(right[name])
        condition = one if condition is None else condition & one
    return condition


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Run with a session setting, then put back what it was."""
    was = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, was) if was is not None else spark.conf.unset(name)
