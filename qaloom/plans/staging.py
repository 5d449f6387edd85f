"""Cutting lineage in a way that outlives a lost executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession
from pyspark.sql.classic.dataframe import DataFrame


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Keep the cluster's `spark.checkpoint.dir`; only on a single machine (tests), where it is unset, set a folder.

    On a cluster without one an error is raised: a folder of the driver's machine can't be read by executors.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="qaloom-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)


def staged(df: DataFrame, eager: bool = True) -> DataFrame:
    """Write `df` to the shared checkpoint folder and read it back from there.

    The files are on shared storage, so a later read survives the loss of any executor.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def settled(df: DataFrame) -> DataFrame:
    """`staged` for loops: what the planner knows of the rows (constraints, sizes) is forgotten with the lineage.

    A checkpoint keeps the constraints of its plan, which multiply with every round of a loop of joins until planning
    takes longer than the work. Sizes are then known from the shuffles, at run time.
    """
    done = staged(df)
    session = df.sparkSession
    plain = session._jsparkSession.internalCreateDataFrame(done._jdf.queryExecution().toRdd(), done._jdf.schema(), False)
    return DataFrame(plain, session)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, for tables that a query writes and reads back."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()
