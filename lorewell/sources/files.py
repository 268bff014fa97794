"""Reading files as memories; export and import of a store as Parquet or as one archive."""

from __future__ import annotations

import os
import tarfile

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_texts(spark: SparkSession, *paths: str) -> DataFrame:
    """(content, source): each file is one record, trimmed."""
    raw = spark.read.text(list(paths), wholetext=True)
    return raw.select(F.btrim("value", F.lit(" \t\r\n")).alias("content"), F.col("_metadata.file_path").alias("source"))


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines."""
    return spark.read.schema(schema).json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def pack(folder: str, archive: str) -> None:
    """A local store folder as .tar.gz, but for lock files."""
    with tarfile.open(archive, "w:gz") as tar:
        for root, _, names in os.walk(folder):
            for name in sorted(names):
                if name != "LOCK":
                    full = os.path.join(root, name)
                    tar.add(full, os.path.relpath(full, folder))


def unpack(archive: str, folder: str) -> None:
    """Members that lead outside of the folder are an error."""
    if os.path.exists(folder) and os.listdir(folder):
        raise FileExistsError(folder)
    with tarfile.open(archive, "r:gz") as tar:
        base = os.path.realpath(folder)
        for m in tar.getmembers():
            if not os.path.realpath(os.path.join(base, m.name)).startswith(base + os.sep):
                raise ValueError(f"{m.name} leads outside of the folder")
        tar.extractall(folder, filter="data")
