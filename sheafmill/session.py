"""The engine's session, and its code on the executors' Python path."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent
#: Where tests and single machines write; a cluster names its own folder.
LOCAL_SHARED = "/tmp/checkpoints"
_SHIPPED: set[str] = set()


def session(master: str = "local[8]", partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(master)
        .appName("sheafmill")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors once an application, so that Python operators can import it anywhere."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        where = Path(tempfile.mkdtemp(prefix="sheafmill-")) / "sheafmill.zip"
        with zipfile.ZipFile(where, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, os.path.join("sheafmill", p.relative_to(PACKAGE)))
        spark.sparkContext.addPyFile(str(where))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the cluster's spark.checkpoint.dir; only a local master may do without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return LOCAL_SHARED


def own_folder(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    root = f"{shared_folder(spark)}/sheafmill-plans-{spark.sparkContext.applicationId}"
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(path)
    files.deleteOnExit(path)
    return f"{root}/{tag}-{uuid.uuid4().hex}"
