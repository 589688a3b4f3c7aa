"""What several operators need of the session."""

from __future__ import annotations

import contextlib
import ctypes

import pyarrow as pa
from pyspark.sql import DataFrame


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, in the folder that the cluster names, or a local one where none is named."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.getConf().get("spark.master") or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        context.setCheckpointDir(named or "/tmp/checkpoints")
    return df.checkpoint()


def give_back() -> None:
    """Return what is free in this worker to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)
