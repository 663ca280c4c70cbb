"""Session helpers shared by operators and jobs."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach.

    The configured one, always.  Only a local session, whose tasks run in this very process,
    may fall back to a temporary folder.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(configured)
        return configured
    current = context.getCheckpointDir()
    if current:
        return current
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    local = tempfile.mkdtemp(prefix="opinara-")
    context.setCheckpointDir(local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one written table."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage, so lost executors cost no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def lookup_join(rows: DataFrame, table: DataFrame, key: str, how: str = "left", bounded: bool = False) -> DataFrame:
    """Join a large token stream with a lookup table.

    ``bounded=True`` is for tables whose size is fixed by construction.  For any other the
    measured size decides at run time (`spark.sql.autoBroadcastJoinThreshold`, in bytes), and
    the partition of a very frequent token is split by the adaptive skew join.
    """
    return rows.join(F.broadcast(table) if bounded else table, key, how)
