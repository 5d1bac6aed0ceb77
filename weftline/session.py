"""Session defaults and the shipping of this package to executors."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Bytes of an Arrow batch, beside the bound on its rows.
BATCH_BYTES = 32 << 20

_SHIPPED: set[str] = set()


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with this engine's defaults; on a cluster, pass your own session to the operators instead."""
    builder = SparkSession.builder.master(master).appName("weftline")
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in the Python workers, once per application, and bound the bytes that these are handed at once."""
    sc = spark.sparkContext
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "2147483647", "2147483647b") or int(re.sub(r"\D", "", spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) or 0) > BATCH_BYTES:
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    if sc.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.abspath(__file__))
        name = os.path.basename(root)
        path = os.path.join(tempfile.gettempdir(), f"{name}-{uuid.uuid4().hex}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, files in os.walk(root):
                for f in files:
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join(name, os.path.relpath(full, root)))
        sc.addPyFile(path)
        _SHIPPED.add(sc.applicationId)
    return spark


_MOVES = re.compile(r"\b(?:Join|Aggregate|Repartition\w*|RebalancePartitions|Sort|Window|Distinct|GlobalLimit|LocalLimit|Union)\b")


def spread(df: DataFrame) -> DataFrame:
    """A table for a heavy kernel: one of fewer partitions than there are cores is spread over these; others, and what isn't a plain scan, stay as they are."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    cores = df.sparkSession.sparkContext.defaultParallelism
    if _MOVES.search(plan) or df._jdf.rdd().getNumPartitions() >= cores:
        return df
    return df.repartition(cores)
