"""Where jobs keep stream checkpoints and written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

SHARED = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}  # folders of local sessions that name none, by application


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """A new folder name below the session's ``spark.checkpoint.dir``.

    All executors must see the folder. A cluster session that names none is
    refused; a local one gets a folder of its own, once.
    """
    base = spark.conf.get(SHARED, None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError(f"set {SHARED} to a folder that all executors share")
        application = spark.sparkContext.applicationId
        if application not in _OWN:
            _OWN[application] = tempfile.mkdtemp(prefix="wiresift-")
        base = _OWN[application]
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
