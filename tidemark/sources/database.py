"""Vector tables in a database, through Spark's JDBC source: (id, vector), the vector as its text form ``[a,b,..]``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vectors as V
from .tables import check_rows


def read_vectors(spark: SparkSession, url: str, name: str, parts: int = 8, expected: int | None = None, id_column: str = "id", vector_column: str = "vector", quote: str = '"', **options: str) -> DataFrame:
    """vec_id, embedding of a table, read in ``parts`` ranges of its id; raises if it hasn't the ``expected`` number of rows.

    ``quote``: what the database puts around column names.
    """
    for x in (name, id_column, vector_column):
        V.check_identifier(x)
    source = lambda: spark.read.format("jdbc").option("url", url).options(**options)
    low, high = source().option("query", f"SELECT MIN({quote}{id_column}{quote}) AS low, MAX({quote}{id_column}{quote}) AS high FROM {name}").load().first()
    if low is None:
        rows = source().option("dbtable", name).load()
    else:
        rows = source().option("dbtable", name).options(partitionColumn=id_column, lowerBound=low, upperBound=high + 1, numPartitions=parts).load()
    found = rows.select(F.col(id_column).cast("long").alias("vec_id"), V.from_text(F.col(vector_column).cast("string")).alias("embedding"))
    return found if expected is None else check_rows(found, expected)


def write_vectors(rows: DataFrame, url: str, name: str, mode: str = "append", id_column: str = "id", vector_column: str = "vector", **options: str) -> None:
    """Bulk load of (vec_id, embedding); each task writes its own rows."""
    for x in (name, id_column, vector_column):
        V.check_identifier(x)
    out = rows.select(F.col("vec_id").cast("long").alias(id_column), V.to_text(F.col("embedding")).alias(vector_column))
    out.write.format("jdbc").option("url", url).option("dbtable", name).options(**options).mode(mode).save()
