"""Session settings that the library's queries expect."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def build_session(master: str | None = None, app: str = "folioscope", **conf: str) -> SparkSession:
    """A session with ANSI arithmetic, UTC and adaptive execution.

    On a cluster leave ``master`` empty and let spark-submit name it. Values in ``conf`` win
    (underscores stand for dots).
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    if master and master.startswith("local"):
        settings["spark.sql.shuffle.partitions"] = "8"
        settings["spark.driver.memory"] = os.environ.get("FOLIOSCOPE_DRIVER_MEMORY", "8g")
    settings |= {k.replace("_", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the cluster's spark.checkpoint.dir (a temp folder of its own where that is unset, as in tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = tempfile.mkdtemp(prefix="folioscope-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/folioscope/{name}-{uuid.uuid4().hex}"
