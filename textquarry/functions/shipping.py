"""Makes the package importable in Python workers that were started elsewhere."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

#: Bytes after which a batch of rows goes to a Python worker; Spark's limit of 64 MB is held several times by each task, in the JVM and in the worker.
BATCH_BYTES = 4 << 20

_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the package to the application once, as an archive that Spark hands to every executor."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return spark
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="package-"), f"{os.path.basename(root)}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
    return spark


def bounded(spark: SparkSession) -> SparkSession:
    """``ship``, and batches of at most ``BATCH_BYTES`` and a row for the session; a lower limit of its own stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key, "64m")
    if not 0 < spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(have) <= BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")
    return ship(spark)
