"""Making the package importable in Python workers."""

from __future__ import annotations

import atexit
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()
#: Bytes of a batch that a worker gets: what it holds grows with a batch's rows, up to 10,000 otherwise, and with what is made of them.
BATCH_BYTES = 1 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches to the workers of this session have at most BATCH_BYTES, or fewer if the session says so."""
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH)) > BATCH_BYTES:
        spark.conf.set(_BATCH, BATCH_BYTES)


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the workers, once per application.

    The archive is only the driver's copy; Spark serves it to every executor,
    also to those that join later.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    handle, path = tempfile.mkstemp(prefix="corpusloom-", suffix=".zip")
    os.close(handle)
    atexit.register(Path(path).unlink, missing_ok=True)
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*")):
            if p.suffix in {".py", ".json", ".txt"}:
                z.write(p, p.relative_to(root.parent))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
