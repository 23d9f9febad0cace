"""Cutting lineage where a result is used several times."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def written(frame: DataFrame) -> DataFrame:
    """The frame's rows, written to the folder that the session names in spark.checkpoint.dir; its lineage ends there.

    Local sessions that name none, such as tests, use a temporary folder; on a cluster, whose
    executors wouldn't share it, a missing setting is an error.
    """
    context = frame.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return frame.checkpoint(eager=True)
