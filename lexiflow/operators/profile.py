"""Structure profiles of JSON documents and table statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def json_profile(df: DataFrame, json_col: str) -> DataFrame:
    """(key, kind, documents, sample): top-level keys of JSON objects, the kinds of their values, the least value cut to 100 characters.

    Text that is no JSON object has no keys.
    """
    entries = df.select(F.explode(F.map_entries(F.from_json(json_col, "map<string,string>"))).alias("e")).select("e.key", "e.value")
    value = F.col("value")
    kind = (
        F.when(value.isNull(), "null")
        .when(value.rlike(r"^\s*\{"), "object")
        .when(value.rlike(r"^\s*\["), "array")
        .when(value.isin("true", "false"), "boolean")
        .when(value.rlike(r"^-?\d+$"), "integer")
        .when(value.rlike(r"^-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?$"), "number")
        .otherwise("string")
    )
    return entries.withColumn("kind", kind).groupBy("key", "kind").agg(F.count("*").alias("documents"), F.left(F.min("value"), F.lit(100)).alias("sample"))


def date_span(df: DataFrame, by: str, date_col: str) -> DataFrame:
    """(by, rows, first, last, days)."""
    return df.groupBy(by).agg(F.count("*").alias("rows"), F.min(date_col).alias("first"), F.max(date_col).alias("last")).withColumn("days", F.datediff("last", "first"))
