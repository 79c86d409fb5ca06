"""Session construction. Only defaults that hold at every scale are set here; sizes come from the cluster."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(master: str | None = None, app: str = "corpusloom", **conf: str) -> SparkSession:
    """A session with the defaults above; ``conf`` keys may use ``__`` for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def local(cpus: int | None = None, memory: str = "8g", **conf: str) -> SparkSession:
    """Local session for tests and the bench."""
    n = cpus or os.cpu_count() or 8
    base = {"spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.shuffle.partitions": str(n)}
    out = session(f"local[{n}]", **(base | conf))
    out.sparkContext.setLogLevel("ERROR")
    return out


#: Bytes from which an Arrow batch is sent to Python. A batch lies in two buffers of the JVM, each of up to twice its bytes, and in its
#: Python worker, for each core of an executor; Spark's own bounds (10,000 rows or 64 MB) let that take hundreds of MB beside the heap.
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 21)


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of whole texts, unless the application has set a bound itself. Results do not depend on it."""
    if BATCH[0] not in spark.conf.getAll:
        spark.conf.set(*BATCH)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, so that the functions run there can import it."""
    sc = spark.sparkContext
    if getattr(sc, "_corpusloom_shipped", False):
        return
    here = Path(__file__).resolve().parent
    if here.is_dir():  # else it was itself imported from an archive that was shipped
        folder = tempfile.mkdtemp(prefix="corpusloom-")
        with zipfile.ZipFile(f"{folder}/corpusloom_package.zip", "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(here.rglob("*.py")):
                z.write(p, p.relative_to(here.parent))
        sc.addPyFile(f"{folder}/corpusloom_package.zip")
    sc._corpusloom_shipped = True
