"""Stage boundaries: tables that a job writes once, reads as often as it likes, and deletes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``.

    Where that setting is missing, a local session (tests) gets a temporary folder of its own.  On a cluster such a folder
    would be invisible to other machines, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="labelspark-")
        delete_at_exit(spark, base)
    return base.rstrip("/")


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """Delete an existing folder when the driver ends, if nothing has deleted it before."""
    place, files = _file_system(spark, path)
    files.deleteOnExit(place)


def delete(spark: SparkSession, path: str) -> None:
    place, files = _file_system(spark, path)
    files.delete(place, True)


class Stages:
    """The intermediate tables of one job.

    Used as a context, the tables are gone at its end, so results that read them must be written or collected inside.  A
    plan that is handed on unfinished takes a ``Stages`` without a context; its tables go when the driver ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def folder(self, name: str) -> str:
        """A fresh folder below the shared one, deleted with the others."""
        path = f"{shared_folder(self.spark)}/{name}-{uuid.uuid4().hex[:12]}"
        place, files = _file_system(self.spark, path)
        files.mkdirs(place)
        delete_at_exit(self.spark, path)
        self.paths.append(path)
        return path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` computed once, as a Parquet table: it is read back where it is used, also after executors are lost."""
        path = self.folder(name)
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self.paths:
            delete(self.spark, path)
        self.paths = []

    def __enter__(self) -> Stages:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Results(Mapping):
    """The results of a job by name, each planned when it is first asked for.

    A result that writes tables of its own then costs nothing to those who want another one.
    """

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)
