"""Sinks: JSON lines, small JSON arrays, splits, Parquet, packed rows with metadata, build-once tables."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame


def json_lines(df: DataFrame, path: str) -> None:
    """One object a line; nulls stay."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_array(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One indented array in one local file, for small tables only: over `most` rows it is refused."""
    rows = df.limit(most + 1).toJSON().collect()
    if len(rows) > most:
        raise ValueError(f"over {most} rows: write JSON lines instead")
    with open(path, "w", encoding="utf-8") as f:
        json.dump([json.loads(r) for r in rows], f, ensure_ascii=False, indent=2)


def by_split(df: DataFrame, path: str, column: str = "split") -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy(column).json(path)


def parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def packed(df: DataFrame, path: str, **metadata) -> None:
    """Packed rows, and one row that says how they were packed."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/packed")
    spark.createDataFrame([(json.dumps(metadata, sort_keys=True),)], "metadata string").write.mode("overwrite").text(f"{path}/metadata")


def cached(spark, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at `path`, built and written first if it isn't there."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
