"""Folders for stores that live as long as a query."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_own: list[str] = []


def scratch_folder(spark: SparkSession) -> str:
    """Under spark.checkpoint.dir, which all executors share; a local folder
    only where that is not set on one machine, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="tessera-store-"))
        root = _own[0]
    return f"{root.rstrip('/')}/store-{uuid.uuid4().hex}"
