"""Query streams: Zipf ranks, scrambled topics, interpolated variants, visit slots, extra vectors, operation mixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors as V


def uniform(i: Column, salt: int = 0) -> Column:
    """A repeatable number in [0, 1) by arithmetic that any engine has: a linear congruence of the id."""
    return F.pmod((i + 1) * 48271 + salt * 69621, F.lit(2147483647).cast("long")).cast("double") / F.lit(2147483647.0)


def zipf_constants(n: int, theta: float) -> dict[str, float]:
    zeta = lambda m: sum(1.0 / i**theta for i in range(1, m + 1))
    zn = zeta(n)
    return {"zeta_n": zn, "alpha": 1 / (1 - theta), "eta": (1 - (2.0 / n) ** (1 - theta)) / (1 - zeta(2) / zn), "half": 1 + 0.5**theta}


def zipf_rank(u: Column, n: int, theta: float) -> Column:
    """Rank in [0, n) of a uniform number by the inverse-distribution approximation; theta in (0, 1)."""
    if not 0 < theta < 1:
        raise ValueError("the skew must lie between 0 and 1")
    c = zipf_constants(n, theta)
    far = F.floor(F.lit(float(n)) * F.pow(F.lit(c["eta"]) * u - c["eta"] + 1, F.lit(c["alpha"])))
    return F.when(u * c["zeta_n"] < 1, 0).when(u * c["zeta_n"] < c["half"], 1).otherwise(F.greatest(F.lit(0), F.least(F.lit(n - 1), far))).cast("long")


def uniform_topic(u: Column, n: int) -> Column:
    """Topic in [0, n) of a uniform number, all alike likely: a frozen uniform plan is this over the places of a stream."""
    return F.least(F.lit(n - 1), F.floor(u * n)).cast("long")


def scramble(rank: Column, n: int) -> Column:
    """Topic of a rank: FNV-1a modulo n, so that popular topics lie anywhere."""
    return F.call_function("mod", V.fnv1a(rank), F.lit(n).cast("decimal(20,0)")).cast("long")


def partner(topic: Column, h: Column, n: int) -> Column:
    """Another topic than ``topic``."""
    return F.pmod(topic + 1 + F.pmod(h, F.lit(n - 1)), F.lit(n)).cast("long")


def interpolated(stream: DataFrame, base: DataFrame, weight: Column) -> DataFrame:
    """``stream`` (.., topic, partner) with ``embedding`` between the two vectors."""
    a = base.select(F.col("vec_id").alias("topic"), F.col("embedding").alias("__a"))
    b = base.select(F.col("vec_id").alias("partner"), F.col("embedding").alias("__b"))
    return stream.join(a, "topic").join(b, "partner").select(*stream.columns, V.lerp(F.col("__a"), F.col("__b"), weight).alias("embedding"))


def groups(base: DataFrame, n: int, members: int, most: float = 0.5) -> DataFrame:
    """Frozen variants: topic, member, partner, lam for each vector and member."""
    rows = base.select(F.col("vec_id").alias("topic"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(members - 1).cast("long"))).alias("member"))
    rows = rows.withColumn("h", F.col("topic") * members + F.col("member"))
    return rows.select("topic", "member", partner(F.col("topic"), F.col("h") * 7 + 3, n).alias("partner"), (uniform(F.col("h"), 1) * most).alias("lam"))


def visit_slots(visits: DataFrame, slots: int) -> DataFrame:
    """``visits`` (seq, topic) with the slot of the t-th visit to a topic; later visits than slots are pending (null)."""
    t = F.row_number().over(Window.partitionBy("topic").orderBy("seq")) - 1
    return visits.withColumn("visit", t.cast("long")).withColumn("slot", F.when(F.col("visit") < slots, F.col("visit")))


def operation(u: Column, read: float, update: float, insert: float, scan: float) -> Column:
    """read, update, insert, scan or read-modify-write by shares."""
    return F.when(u < read, "read").when(u < read + update, "update").when(u < read + update + insert, "insert").when(u < read + update + insert + scan, "scan").otherwise("rmw")


def stream_stats(stream: DataFrame) -> DataFrame:
    """One row: rows, topics, members, lam_min, lam_mean, lam_max."""
    return stream.agg(F.count("*").alias("n"), F.count_distinct("topic").alias("topics"), F.count_distinct("topic", "member").alias("members"), F.min("lam").alias("lam_min"), F.avg("lam").alias("lam_mean"), F.max("lam").alias("lam_max"))


def clean_text(text: Column) -> Column:
    """Line ends and repeated blanks to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\r\n]+", " "), r" +", " "))


def acceptable(text: Column, least: int, most: int) -> Column:
    """Whether a cleaned text has from least to most words."""
    words = F.size(F.split(clean_text(text), " "))
    return (F.length(clean_text(text)) > 0) & words.between(least, most)
