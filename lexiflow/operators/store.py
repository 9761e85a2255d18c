"""Keyed tables without a MERGE: inserts, upserts, updates and deletes as DataFrame plans.

Every function takes the stored table and a change and returns the new table; ``write_version``
publishes it as a new version, so a reader never sees half a change.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _no_null(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def dedupe_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of every key by ``order``; rows with a null in the key are dropped."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.where(_no_null(keys)).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_ignore(stored: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Stored rows, and the first new row of each key that isn't stored."""
    fresh = dedupe_first(new, keys, order).join(stored.select(*keys), keys, "left_anti")
    return stored.unionByName(fresh.select(*stored.columns))


def upsert(stored: DataFrame, new: DataFrame, keys: list[str], order: list, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per key: new values where there are any, columns of ``keep`` as stored.

    Of several new rows of a key the first by ``order`` counts; null keys are dropped.
    """
    fresh = dedupe_first(new, keys, order)
    s, n = stored.alias("s"), fresh.alias("n")
    both = s.join(n, [F.col(f"s.{k}") == F.col(f"n.{k}") for k in keys], "full_outer")
    is_new = F.col(f"n.{keys[0]}").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(f"s.{c}", f"n.{c}").alias(c)
        if c in keep:
            return F.when(F.col(f"s.{keys[0]}").isNotNull(), F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
        return F.when(is_new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c)

    return both.select(*[value(c) for c in stored.columns])


def bulk_update(stored: DataFrame, new: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Stored rows with the new values of their keys; unknown keys are ignored."""
    known = new.join(stored.select(*keys), keys, "left_semi")
    filled = [c if c in new.columns else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
    return upsert(stored, known.select(*filled), keys, order, keep=tuple(c for c in stored.columns if c not in new.columns))


def append(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new rows, columns by name."""
    return stored.unionByName(new.select(*stored.columns))


def load_relationship(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Every parent with its child, of which there is one at most, as a struct; null where it has none."""
    child = children.select(F.col(child_key).alias("_key"), F.struct(*[F.col(c) for c in children.columns if c != child_key]).alias(name))
    return parents.join(child, parents[key] == child["_key"], "left").drop("_key")


def logged(df: DataFrame, log) -> DataFrame:
    """The same rows; the optimised plan with its literals goes to ``log``."""
    log(df._jdf.queryExecution().optimizedPlan().toString())
    return df


def update_where(stored: DataFrame, condition: Column, values: dict[str, Column]) -> DataFrame:
    return stored.select(*[F.when(condition, values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in stored.columns])


def delete_keys(stored: DataFrame, keys: DataFrame) -> DataFrame:
    return stored.join(keys.distinct(), keys.columns, "left_anti")


def delete_where(stored: DataFrame, *conditions: Column) -> DataFrame:
    """Rows for which not all conditions hold; a condition that is null doesn't hold."""
    return stored.where(~F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False)))


def select_where(stored: DataFrame, *conditions: Column, limit: int | None = None) -> DataFrame:
    found = stored.where(reduce(lambda a, b: a & b, conditions)) if conditions else stored
    return found if limit is None else found.limit(limit)


def newest(rows: DataFrame, condition: Column, date_col: str, key: str, n: int) -> DataFrame:
    """The ``n`` newest rows of a condition; equal dates by key."""
    return rows.where(condition).orderBy(F.desc(date_col), key).limit(n)


def write_version(table: DataFrame, path: str, version: int) -> str:
    """Append-only versions: ``path/version=n``; fails if the version is there already."""
    out = f"{path}/version={version}"
    table.write.mode("errorifexists").parquet(out)
    return out


def create_table(spark: SparkSession, name: str, schema: str) -> None:
    spark.createDataFrame([], schema).write.mode("ignore").format("parquet").saveAsTable(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def run_sql(spark: SparkSession, sql: str, **args) -> DataFrame:
    """Raw SQL with named parameters."""
    return spark.sql(sql, args=args)
