"""Session settings that the operators count on."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import SparkSession

_own_folder: str | None = None


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share, without a slash at its end.

    ``spark.checkpoint.dir`` when the session has it; otherwise, if all runs on
    one machine (tests), a temporary folder that goes away with the driver.
    A cluster without the setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own_folder
    if _own_folder is None:
        _own_folder = tempfile.mkdtemp(prefix="pelorus-stages-")
        atexit.register(shutil.rmtree, _own_folder, ignore_errors=True)
    return _own_folder


def session(app: str = "pelorus", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive plans, skew handling, UTC and Arrow transfer; ``conf`` overrides."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
