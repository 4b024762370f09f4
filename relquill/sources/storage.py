"""Intermediate results in the folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset, a temporary folder in local mode and a folder of the warehouse on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if master.startswith("local") and "cluster" not in master:
            made = tempfile.mkdtemp(prefix="relquill-")
            atexit.register(shutil.rmtree, made, ignore_errors=True)
            _own[app] = f"file://{made}"
        else:
            _own[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return _own[app]


def stage(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: the lineage ends here, and lost executors lose nothing."""
    path = f"{shared_dir(df.sparkSession)}/relquill/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
