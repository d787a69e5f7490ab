"""The package on the workers' path, wherever the driver runs from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Bytes of a batch of rows that goes to a worker, where the session doesn't say otherwise: whole texts are wide rows.
BATCH_BYTES = "6m"
_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def ship(spark: SparkSession) -> None:
    """Send the package's modules to all workers, once per context; functions that run there import them. Bounds batches by bytes."""
    context = spark.sparkContext
    if _KEY not in spark.conf.getAll:
        spark.conf.set(_KEY, BATCH_BYTES)
    if getattr(context, "_quern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    if root.parent.suffix != ".zip":
        # Only the driver reads this file; executors fetch it from the driver.
        target = Path(tempfile.mkdtemp(prefix="quern-")) / "quern_modules.zip"
        with zipfile.ZipFile(target, "w") as out:
            for source in sorted(root.rglob("*.py")):
                out.write(source, source.relative_to(root.parent))
        context.addPyFile(str(target))
    context._quern_shipped = True
