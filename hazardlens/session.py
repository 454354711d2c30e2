"""Session helpers: settings the operators rely on, and shared scratch space."""

from __future__ import annotations

import atexit
import os
import shutil
import site
import tempfile
import uuid

from pyspark.sql import SparkSession


#: A state store that keeps its keys on disk and writes what a batch changes only.
KEYED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def build_session(app_name: str = "hazardlens", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        **KEYED_STATE,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """All event times are UTC; make the session render and parse them so."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def use_keyed_state(spark: SparkSession) -> SparkSession:
    """Streams that start from now on keep their state in a keyed store."""
    for key, value in KEYED_STATE.items():
        spark.conf.set(key, value)
    return spark


_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder every executor can reach, below ``spark.checkpoint.dir``.

    A session with a ``local`` master that has no such setting gets one, as driver and executors
    are the same machine. The folder is removed when the process ends, or before by
    ``remove_shared_dirs``.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        base = os.path.join(tempfile.gettempdir(), "hazardlens")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    _made.append((spark, folder))
    return folder


def remove_shared_dirs() -> None:
    """Delete the folders that this process has made; results that read them end with it."""
    while _made:
        spark, folder = _made.pop()
        try:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session is gone already; its folders stay
            return


atexit.register(remove_shared_dirs)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, unless they find it as the driver does.

    Workers import what the tasks call. They see the driver's working folder, ``PYTHONPATH`` and
    installed packages; a package found elsewhere goes along as an archive, once per application.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep), *site.getsitepackages()]
    application = spark.sparkContext.applicationId
    if application in _shipped or root in (os.path.abspath(p) for p in seen if p):
        return
    name = os.path.join(tempfile.mkdtemp(prefix="package-"), "hazardlens")
    spark.sparkContext.addPyFile(shutil.make_archive(name, "zip", root, "hazardlens"))
    _shipped.add(application)
