"""Python workers: code for executors."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once for each Spark application."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="umbra-"), "umbra.zip")  # executors fetch it from the driver as long as the application runs
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(target)
    _shipped.add(sc.applicationId)


def parts(rows: DataFrame) -> int:
    """Partitions for Python to work on a table, or on what is joined with it: some for each core, more for tables of over 4 MB a part in their files.

    A worker holds whole Arrow batches, of up to 10,000 rows: parts of a few MB keep these from growing with the table.
    """
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()  # above joins Spark's estimates are products
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, sum(s for s in sizes if s < 1 << 50) >> 22)  # rows of the driver have no size


def joint(rows: DataFrame) -> int:
    """Partitions to join or group a table in: as many as Spark would take, more for tables whose parts would outgrow a task's memory."""
    return max(parts(rows), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def spread(rows: DataFrame) -> DataFrame:
    """rows over all cores, and in parts by size: one file or split is one task, however long its rows take, and fills a worker's batches."""
    return rows.repartition(parts(rows))
