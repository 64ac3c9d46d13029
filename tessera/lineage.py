"""Cutting lineage where a table is read more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder, spark.checkpoint.dir; its lineage ends there.

    Without that setting, and without a folder given to the session, a folder is chosen in local mode only, where all executors are threads of one process.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = f"{context.getConf().get('spark.local.dir', '/tmp')}/checkpoints-{context.applicationId}"
        context.setCheckpointDir(folder)
    return df.checkpoint()


def released(df: DataFrame) -> None:
    """Deletes the files of `df`, which checkpointed() returned, before Spark's cleaner happens to. Nothing that is still to be computed may read it."""
    file = df._jdf.queryExecution().logical().rdd().getCheckpointFile()
    if file.isDefined():
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(file.get())
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
