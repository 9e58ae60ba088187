"""Session settings used by the bench, the tests and stand-alone jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(app: str = "labelspark", master: str | None = None, partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """A session with adaptive execution, skew handling and UTC timestamps.

    On a cluster leave ``master`` and ``partitions`` unset: the deployment decides, and adaptive
    execution coalesces or splits shuffle partitions at run time.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # split a hot join key even where that costs one more shuffle
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if partitions:
        settings["spark.sql.shuffle.partitions"] = str(partitions)
    settings.update(extra or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
