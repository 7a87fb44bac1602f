"""Paths in the folder that driver and executors share, for data that need not outlive the application."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import SparkSession

_scopes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session has none, a local session gets a temporary folder; a cluster raises, since
    a machine-local folder would lose files there.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="snaplog-")
    sc.setCheckpointDir(own)
    return sc.getCheckpointDir() or own


def new_path(spark: SparkSession, what: str) -> str:
    """A fresh path in the shared folder. It goes with the ``scope`` it was made in, or else when the driver's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/snaplog-{what}-{uuid.uuid4().hex}"
    # the JVM's own hook works after spark.stop() too, which Python can't reach any more
    fs, place = _hadoop(spark, path)
    fs.deleteOnExit(place)
    for scope in _scopes[-1:]:
        scope.append(path)
    return path


@contextmanager
def scope(spark: SparkSession):
    """Removes what was made inside when it ends: for callers that have written or consumed the results."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            fs, place = _hadoop(spark, path)
            fs.delete(place, True)
            fs.cancelDeleteOnExit(place)


def _hadoop(spark: SparkSession, path: str):
    sc = spark.sparkContext
    place = sc._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(sc._jsc.hadoopConfiguration()), place
