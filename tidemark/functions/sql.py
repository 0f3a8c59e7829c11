"""The vector functions under names that Spark SQL finds, and a table function that unfolds result lists."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

_TWO = "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>"
_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (s, x) -> s + x)"
FUNCTIONS = {
    "vector_l2": (_TWO, "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> (x - y) * (x - y)), 0D, (s, x) -> s + x)"),
    "vector_ip": (_TWO, "DOUBLE", f"-{_DOT.format('a', 'b')}"),
    "vector_cosine": (_TWO, "DOUBLE", f"if({_DOT.format('a', 'a')} * {_DOT.format('b', 'b')} = 0D, 3.4028234663852886E38D, 1D - {_DOT.format('a', 'b')} / (sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})))"),
}


class Neighbors:
    """``SELECT * FROM neighbors(ids, dists)``: a row (rnk, neighbor_id, dist) for each element, in order."""

    def eval(self, ids: list[int], dists: list[float]) -> Iterator[tuple[int, int, float]]:
        for i, (n, d) in enumerate(zip(ids or [], dists or [], strict=False)):
            yield i + 1, n, d


def register(spark: SparkSession) -> None:
    """Temporary functions of the session: expressions that Catalyst inlines, and the table function ``neighbors``."""
    for name, (inputs, kind, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({inputs}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("neighbors", udtf(Neighbors, returnType="rnk bigint, neighbor_id bigint, dist double"))
