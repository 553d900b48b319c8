"""Session settings and the shared folder for written intermediate tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
_steps_folder: ContextVar[str | None] = ContextVar("steps_folder", default=None)


def build_session(app: str, master: str | None = None, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; on a cluster pass the cluster's own session around."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared folder the cluster names.

    Where ``spark.checkpoint.dir`` is not set, the folder is in the session's warehouse, which all
    executors reach as well.
    """
    base = _steps_folder.get() or spark.conf.get(CHECKPOINT_DIR, None)
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


@contextmanager
def steps_folder(spark: SparkSession, path: str) -> Iterator[None]:
    """Intermediate tables go to the folder ``path``, which is deleted at the end: what is made
    within must be written elsewhere by then."""
    token = _steps_folder.set(path)
    try:
        yield
    finally:
        _steps_folder.reset(token)
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
