"""Cutting a plan that iterations make long."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder that the session names; on one machine, in a folder of its own where none is named."""
    context = df.sparkSession.sparkContext
    if not (context.getCheckpointDir() or df.sparkSession.conf.get("spark.checkpoint.dir", None)):
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tagloom-"))
    return df.checkpoint()
