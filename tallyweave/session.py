"""Session settings, the shared scratch folder, and delivery of this package to Python workers."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def build_session(app: str = "tallyweave", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings that the engine is tested under; a cluster's own settings win where given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``, or the session's checkpoint folder.

    Only a local session, whose driver is its one executor, gets a temporary folder where neither is set; a cluster
    without a shared folder is an error, as other executors would not see what one of them wrote."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = known.get() if known.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"{master}: spark.checkpoint.dir names no shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="tallyweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def release(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _release_at_exit(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            release(spark, path)
    except Exception:  # the session may be gone already; the folder belongs to the cluster's cleaner then
        pass


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared scratch folder, which goes when the session ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_release_at_exit, spark, path)
    return path


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: Spark's file server hands them a zip of it, once a session."""
    context = spark.sparkContext
    if getattr(context, "_tallyweave_shipped", False):
        return
    top = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tallyweave-code-")) / "tallyweave_code.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for path in sorted(top.rglob("*.py")):
            z.write(path, path.relative_to(top.parent))
    context.addPyFile(str(target))
    context._tallyweave_shipped = True
