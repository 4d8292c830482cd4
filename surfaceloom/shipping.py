"""What a session shares: this package on its Python workers, and a folder for intermediate tables."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to every executor, once for each application; those that have it installed lose nothing."""
    context = spark.sparkContext
    if context.applicationId not in _sent:
        _sent.add(context.applicationId)
        package = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="surfaceloom-")
        context.addPyFile(shutil.make_archive(f"{folder}/surfaceloom", "zip", package.parent, package.name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (spark.checkpoint.dir). On one machine without one, as in tests, a temporary one."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not re.match(r"local(\[|\Z)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="surfaceloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        path = f"file://{folder}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")
