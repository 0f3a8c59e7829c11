"""Tables of a data folder, written intermediates, ids and checks."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that is unset and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that all executors share")
        named = _OWN.setdefault(spark.sparkContext.applicationId, tempfile.mkdtemp(prefix="tidemark-"))
    return named


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a written table: its lineage ends there."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reuse_or_compute(spark: SparkSession, path: str, compute, enough=lambda df: True) -> DataFrame:
    """A stored table if it can be read and is ``enough``; else what ``compute()`` gives, stored for the next time."""
    try:
        df = spark.read.parquet(path)
        if enough(df):
            return df
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e) and "CANNOT_READ" not in str(e):
            raise
    compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def check_rows(df: DataFrame, expected: int) -> DataFrame:
    """Raises if a table hasn't as many rows as its header says."""
    n = df.count()
    if n != expected:
        raise ValueError(f"{n} rows; {expected} were expected")
    return df


def events(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Rows of JSON lines; what stands before the first brace is skipped, as are lines that aren't JSON objects."""
    text = F.regexp_extract(F.col(column), r"\{.*\}", 0)
    return lines.select(F.from_json(text, schema).alias("e")).where("e is not null").select("e.*")


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return events(spark.read.text(path), schema)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
