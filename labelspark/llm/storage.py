"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from labelspark import stage

_scopes: list[list[str]] = []  # the tables written in each open ``scratch``


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir`` (see ``stage.shared_folder``)."""
    return f"{stage.shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def write_table(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts the lineage, survives lost executors.

    The table goes with the ``scratch`` that is open (not with ``keep``), else when the driver ends.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    stage.delete_at_exit(df.sparkSession, path)
    if _scopes and not keep:
        _scopes[-1].append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables written inside as soon as it is left; results that read them must be written before."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            stage.delete(spark, path)
