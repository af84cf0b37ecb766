"""Places in the folder that the cluster shares, for checkpoints and results of streams."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place under spark.checkpoint.dir that goes when the driver ends. Where that is unset, a local folder is set on one machine; on a cluster that is an error."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        top = Path(tempfile.mkdtemp(prefix="chirplake-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", top)
    path = f"{top.rstrip('/')}/chirplake/{name}-{uuid.uuid4().hex}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path
