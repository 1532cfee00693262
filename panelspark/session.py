"""Session settings.  On a cluster the caller's session is used as it is."""
from __future__ import annotations

import io
import os
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cpus: int | str | None = None, shuffle_partitions: int = 8, conf: dict[str, str] | None = None) -> SparkSession:
    """Local session for tests, the oracle check and the bench."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
    os.environ.setdefault("OPENBLAS_NUM_THREADS", "1")
    builder = (SparkSession.builder.master(f"local[{cpus or '*'}]").appName("panelspark")
             .config("spark.sql.shuffle.partitions", shuffle_partitions)
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.execution.arrow.pyspark.enabled", "true")
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "12g"))
    shared = os.path.join(os.environ.get("TMPDIR", "/tmp"), "panelspark-shared")  # one machine: every task sees it
    for k, v in ({"spark.checkpoint.dir": shared} | (conf or {})).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark



_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per application, so jobs run from any working directory.

    The archive goes to the shared folder first: an executor that joins later fetches it from there.
    """
    app, base = spark.sparkContext.applicationId, spark.conf.get("spark.checkpoint.dir", None)
    if app in _shipped or not base:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/{root.name}-{app}.zip")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(path, True)
    out.write(data.getvalue())
    out.close()
    fs.deleteOnExit(path)
    spark.sparkContext.addPyFile(fs.makeQualified(path).toString())
    _shipped.add(app)
