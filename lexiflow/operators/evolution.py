"""History: contexts of a year, periods, volumes, turning points and trends."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import lexicon


def event_rows(spark: SparkSession, events=lexicon.EVENTS) -> DataFrame:
    return spark.createDataFrame(events, "event_year int, event string")


def events_until(docs: DataFrame, id_col: str, year_col: str, events: list[tuple[int, str]] = lexicon.EVENTS) -> DataFrame:
    """(id, year, events): all events of the year or before, in order; the stated event list is part of the plan."""
    ordered = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(e).alias("e")) for y, e in sorted(events)])
    return docs.select(F.col(id_col).alias("id"), F.col(year_col).alias("year"), F.transform(F.filter(ordered, lambda x: x["y"] <= F.col(year_col)), lambda x: x["e"]).alias("events"))


def in_periods(rows: DataFrame, year_col: str, periods: list[tuple[int, int, str]] = lexicon.PERIODS) -> DataFrame:
    """Every row once per period its year lies in, both ends included, with a column ``period``."""
    named = F.array_compact(F.array(*[F.when(F.col(year_col).between(a, b), F.lit(n)) for a, b, n in periods]))
    return rows.withColumn("period", F.explode(named))


def most_common(rows: DataFrame, by: str, what: str, k: int) -> DataFrame:
    """(by, what, count, rank): the ``k`` most frequent values of each group; ties by value."""
    counted = rows.groupBy(by, what).agg(F.count("*").alias("count"))
    return counted.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc("count"), what))).where(F.col("rank") <= k)


def turning_points(volumes: DataFrame, value_col: str, limit: float = 0.06, by: str | None = None) -> DataFrame:
    """(volume_id, delta): volumes that differ from the one before by more than ``limit``.

    One row per volume comes in (aggregate first); without ``by`` they form a single series.
    """
    w = (Window.partitionBy(by) if by else Window.partitionBy(F.lit(1))).orderBy("volume_id")
    rows = volumes.withColumn("delta", F.col(value_col) - F.lag(value_col).over(w))
    return rows.where(F.abs("delta") > limit).select(*([by] if by else []), "volume_id", "delta")


def long_term_trends(frequency: DataFrame, more_than: int = 10) -> DataFrame:
    """(concept, first_volume, last_volume, change_percent) of concepts in more than ``more_than`` volumes."""
    ends = frequency.groupBy("concept").agg(F.count("*").alias("volumes"), F.min(F.struct("volume_id", "frequency")).alias("a"), F.max(F.struct("volume_id", "frequency")).alias("z"))
    change = (F.col("z.frequency") - F.col("a.frequency")) / F.greatest(F.lit(1), F.col("a.frequency")) * 100
    return ends.where(F.col("volumes") > more_than).select("concept", F.col("a.volume_id").alias("first_volume"), F.col("z.volume_id").alias("last_volume"), change.alias("change_percent"))
