"""Ingest manifest of stored files: hash, type by first bytes, size check, storage path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelspark import constants as C
from labelspark.functions.names import slug


def read_files(spark: SparkSession, path: str, most: int = C.MAX_FILE_BYTES) -> DataFrame:
    """Stored files; the content of one above ``most`` bytes is never loaded (NULL), only its length is known."""
    files = spark.read.format("binaryFile").load(path)
    small = files.filter(F.col("length") <= most).select("path", "modificationTime", "length", "content")
    large = files.filter(F.col("length") > most).select("path", "modificationTime", "length", F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def file_kind(content: Column) -> tuple[Column, Column]:
    """(type, extension) by the first bytes."""
    head = F.hex(F.substring(content, 1, 4))
    pdf, png, jpg = head.startswith("25504446"), head.startswith("8950"), head.startswith("FFD8")
    kind = F.when(pdf, "pdf").when(png | jpg, "image").otherwise("html")
    kind = F.when(content.isNotNull(), kind)
    return kind, F.when(pdf, "pdf").when(png, "png").when(jpg, "jpg").otherwise("html")


def manifest(files: DataFrame, year: Column) -> DataFrame:
    """Needs ``prefix, provider_name, content`` (binary); the content itself is not carried along.

    Files above the size limit are marked, not dropped.  A file whose content was not loaded has a ``length``, but no
    type, hash or path.
    """
    kind, extension = file_kind(F.col("content"))
    rows = files.withColumns({
        "file_type": kind,
        "_extension": extension,
        "file_hash": F.sha2("content", 256),
        "bytes": (F.coalesce("length", F.length("content")) if "length" in files.columns else F.length("content")).cast("long"),
    }).drop("content")
    name = F.concat(F.col("prefix").cast("string"), F.lit("_"), F.col("file_type"), F.lit("_"),
                    F.substring("file_hash", 1, 8), F.lit("."), F.col("_extension"))
    return rows.withColumns({
        "file_name": name,
        "file_path": F.when(name.isNotNull(), F.concat_ws("/", F.lit("data/storage"), slug(F.col("provider_name")), year.cast("string"), name)),
        "accepted": F.col("bytes") <= C.MAX_FILE_BYTES,
    }).drop("_extension")
