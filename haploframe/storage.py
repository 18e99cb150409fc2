"""Where tables go that all executors must see."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below spark.checkpoint.dir; where a local session sets none, below a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="haploframe-")
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/haploframe/{tag}-{uuid.uuid4().hex}"
