"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters outside ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_checkpoints(spark: SparkSession) -> None:
    """Point the session at its shared checkpoint folder.

    The cluster names the folder in ``spark.checkpoint.dir``. Where that setting is absent a temporary one is
    made in local mode only, as in tests; on a cluster other machines could not read it, so that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lectern-")
    context.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint: readable after any executor is lost."""
    shared_checkpoints(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole_text(name: str) -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name), F.lit(""))
