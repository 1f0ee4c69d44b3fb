"""Tables kept in the folder that the driver and all executors share, and bounded broadcasts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A table of at most this many narrow rows may be broadcast.
BROADCAST_ROWS = 200_000


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet under the session's checkpoint folder and read again: the lineage is cut, as by a checkpoint."""
    context = df.sparkSession.sparkContext
    path = f"{context.getCheckpointDir()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    context._jvm.System.gc()  # what was shuffled for it goes when the plan is collected
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame) -> DataFrame:
    """``df``, a kept narrow table, with a broadcast hint where its counted size allows one, else left to a shuffle."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df.hint("merge")
