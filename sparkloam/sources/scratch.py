"""Where tables go that are needed for a while only."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared one; a session on one machine may have none, as in tests, and gets a folder that goes with it."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sparkloam-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named}/{name}-{uuid.uuid4().hex}"


def beside(path: str) -> str:
    """A new folder in that of ``path``, of a name that readers skip."""
    above = path.rstrip("/").rpartition("/")[0]
    return f"{above}/_{uuid.uuid4().hex}" if above else f"_{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder, if there is one."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(found, True)
