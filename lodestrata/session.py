"""Sessions, and making this package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent
#: A task holds a batch in the JVM and in Python at once, so batches of long rows must be short.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = "2m"
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Sends the package to the executors, once per application, unless PYTHONPATH has it there; bounds Arrow batches by bytes unless the application does."""
    app = spark.sparkContext.applicationId
    if not spark.sparkContext.getConf().contains(BATCH):
        spark.conf.set(BATCH, BATCH_BYTES)
    known = [Path(p).resolve() for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT.parent not in known and app not in _shipped:
        at = Path(tempfile.mkdtemp(prefix="lodestrata-")) / "lodestrata.zip"
        with zipfile.ZipFile(at, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent))
        spark.sparkContext.addPyFile(str(at))
        _shipped.add(app)
    return spark


def local(cpus: int | str = "*", shuffle: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the benchmark: UTC, adaptive, on this machine."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)
