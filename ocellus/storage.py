"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the folder named by spark.checkpoint.dir. Only a local session without one gets a temporary folder;
    on a cluster a machine's own folder would lose data with the machine, so its absence is an error there."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    named = context.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        context.setCheckpointDir(named)
    elif context.master.startswith("local[") or context.master == "local":
        own = tempfile.mkdtemp(prefix="ocellus-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        context.setCheckpointDir(own)
    else:
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables that a session writes for itself, shared by all executors."""
    ensure_checkpoint_dir(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and returns a frame that reads it; later stages survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(*frames: DataFrame) -> None:
    """Removes the files of frames that cut_lineage() gave and that nothing needs any more, as a loop's earlier rounds. What a result still reads goes with the session's folder, or
    with the frame where spark.cleaner.referenceTracking.cleanCheckpoints is set."""
    for df in frames:
        plan = df._jdf.queryExecution().analyzed()
        if plan.nodeName() == "LogicalRDD" or plan.getClass().getSimpleName() == "LogicalRDD":
            at = plan.rdd().getCheckpointFile()
            if at.isDefined():
                path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(at.get())
                path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
