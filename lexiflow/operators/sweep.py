"""Parameter grids and the results of sweeps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import lexicon

SUCCESS = "(error is null and tokens > 0)"


def grid(spark: SparkSession, values: dict[str, list] = lexicon.PARAMETER_GRID) -> DataFrame:
    """Every combination of the stated values, by exploding one array after another: no join."""
    return reduce(lambda df, kv: df.withColumn(kv[0], F.explode(F.array(*[F.lit(v) for v in kv[1]]))), values.items(), spark.range(1).drop("id"))


def words_in(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def speed(tokens: Column, seconds: Column) -> Column:
    return F.try_divide(tokens.cast("double"), F.nullif(seconds, F.lit(0.0)))


def summary(runs: DataFrame, by: list[str]) -> DataFrame:
    """(by, runs, passed, mean speed and load time of the passed, best run by speed and by memory)."""
    ok = F.expr(SUCCESS)
    fast = F.when(ok, speed(F.col("tokens"), F.col("gen_time")))
    return runs.groupBy(*by).agg(
        F.count("*").alias("runs"), F.count_if(ok).alias("passed"), F.avg(fast).alias("mean_speed"), F.avg(F.when(ok, F.col("load_time"))).alias("mean_load"),
        F.min(F.when(ok & fast.isNotNull(), F.struct((-fast).alias("s"), F.col("run_id")))).getField("run_id").alias("fastest_run"),
        F.min(F.when(ok & F.col("max_vram").isNotNull(), F.struct("max_vram", "run_id"))).getField("run_id").alias("leanest_run"),
    )


def speed_up(runs: DataFrame, by: str) -> DataFrame:
    """(by, best_gpu, best_cpu, ratio): the fastest run with layers on the GPU against the fastest without."""
    fast = F.when(F.expr(SUCCESS), speed(F.col("tokens"), F.col("gen_time")))
    best = runs.groupBy(by).agg(F.max(F.when(F.col("gpu_layers") > 0, fast)).alias("best_gpu"), F.max(F.when(F.col("gpu_layers") == 0, fast)).alias("best_cpu"))
    return best.withColumn("ratio", F.try_divide("best_gpu", F.nullif("best_cpu", F.lit(0.0))))
