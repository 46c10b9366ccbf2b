"""Session factory for local runs and tests; on a cluster the submitted session is used as it is."""
from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8, memory: str = "6g", app: str = "sparquill") -> SparkSession:
    """A local session: UTC, adaptive execution, one shuffle partition a core."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # each expression would ask the JVM for its place in the code
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="sparquill-ckpt-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
