"""What a session needs on a cluster: this package on the executors, and a folder that all share."""

from __future__ import annotations

import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED = "spark.gridwitness.shipped"
#: Bytes of an Arrow batch at most: texts are long, and a batch is held several times over on its way to Python and back.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> SparkSession:
    """Sends this package to all Python workers, once an application: they need not find it by any path of their own. Arrow batches are held small in the session."""
    held = spark.conf.get(_BATCH).rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    if spark.conf.get(_SHIPPED, None) != spark.sparkContext.applicationId:
        root = Path(__file__).resolve().parent
        path = Path(tempfile.mkdtemp(prefix="gridwitness-")) / "gridwitness.zip"
        with zipfile.ZipFile(path, "w") as z:
            for file in sorted(root.rglob("*.py")):
                z.write(file, file.relative_to(root.parent))
        spark.sparkContext.addPyFile(str(path))
        spark.conf.set(_SHIPPED, spark.sparkContext.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and all runs on one machine (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that driver and executors share")
        folder = spark.conf.get("spark.gridwitness.ownCheckpointDir", None)
        if not folder:
            folder = "file://" + tempfile.mkdtemp(prefix="gridwitness-")
            spark.conf.set("spark.gridwitness.ownCheckpointDir", folder)
    return folder.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new name in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
