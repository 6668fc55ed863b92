"""Sources: task tables, templates, records, transcripts, line counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.registry import INPUTS


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(task_group, name) of the task tables under folder/group/name, in any file system that Spark reads."""
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(folder)
    files = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    below = lambda path: sorted((x.getPath().getName(), x.getPath()) for x in files.listStatus(path))
    groups = [(name, path) for name, path in below(top) if files.getFileStatus(path).isDirectory()]
    return spark.createDataFrame([(group, name) for group, path in groups for name, _ in below(path)], "task_group string, name string")


def task(spark:SparkSession, folder: str, group: str, name: str) -> DataFrame:
    """A task's table (Parquet under folder/group/name) with its input columns and `label`; `split` if it has one."""
    df = spark.read.parquet(f"{folder}/{group}/{name}")
    inputs, label, _ = INPUTS.get(name, INPUTS.get(group, INPUTS[None]))
    return df.select(*inputs, F.col(label).alias("label"), *[c for c in ("split",) if c in df.columns])


def templates(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_key, template) of a JSON object of templates."""
    text = spark.read.text(path, wholetext=True)
    entries = F.explode(F.from_json("value", "map<string,string>")).alias("prompt_key", "template")
    rows = text.select(entries)
    alias = rows.filter(F.col("prompt_key") == "SARSCOV2_3CLPro_Diamond").withColumn("prompt_key", F.lit("SARSCoV2_3CLPro_Diamond"))
    return rows.filter(F.col("prompt_key") != "SARSCoV2_3CLPro_Diamond").unionByName(alias)


def json_arrays(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Files of one JSON array each, with `file`, the file's name."""
    return spark.read.schema(schema).option("multiLine", True).json(pattern).withColumn("file", F.col("_metadata.file_name"))


def json_lines(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def splits(spark: SparkSession, folder: str, names: tuple[str, ...] = ("training", "validation", "test")) -> DataFrame:
    """JSON lines of several splits as one table with `split`."""
    out = None
    for name in names:
        part = spark.read.json(f"{folder}/{name}.jsonl").withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out


def sft(spark: SparkSession, path: str, columns: dict[str, str], where: str | None = None) -> DataFrame:
    """Declared source: a column map and a row filter over records."""
    df = spark.read.json(path)
    df = df.filter(where) if where else df
    return df.selectExpr(*[f"`{a}` as `{b}`" for a, b in columns.items()])


def line_counts(spark: SparkSession, folder: str, files: list[str]) -> DataFrame:
    """(file, lines) of the listed files; one that is missing has 0."""
    wanted = spark.createDataFrame([(f,) for f in files], "file string")
    found = spark.read.text(folder, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_name").alias("file"))
    return wanted.join(found.groupBy("file").agg(F.count("*").alias("n")), "file", "left").select("file", F.coalesce("n", F.lit(0)).alias("lines"))


def transcripts(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.text(pattern, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
