"""Where operators cut lineage: the shared folder that the session's spark.checkpoint.dir names, as the record store has it."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from echofold.sources.store import settled, shared_dir

__all__ = ["scratch", "settled", "shared_dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
