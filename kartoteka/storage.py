"""Tables that are computed once: checkpoints in the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder: as it is set, else as ``spark.checkpoint.dir`` names it, else a temporary one on a single machine.

    On a cluster without that setting there is no folder all executors see, which is an error.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = sc.getConf().get("spark.checkpoint.dir", None)
        if not named and not (sc.master.startswith("local") and not sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="kartoteka-"))
    return sc._jsc.sc().getCheckpointDir().get()


def computed_once(df: DataFrame) -> DataFrame:
    """df with its lineage cut, for plans that would expand it in every branch."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
