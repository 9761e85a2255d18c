"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.session import checkpointed, spread  # noqa: F401  (re-exported)

#: Words are unbroken runs of letters and digits, in lower case, with the letter yo read as ye.
WORD = re.compile(r"[^\W_]+")
WORD_JVM = r"[\p{L}\p{N}]+"


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower().replace("ё", "е")) if text else []


def col(name: str) -> Column:
    """A top-level column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def words_of(text: Column) -> Column:
    """``words`` as a Column: array<string>, null for a null text."""
    return F.regexp_extract_all(F.translate(F.lower(text), "ё", "е"), F.lit(WORD_JVM), F.lit(0))


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, n: int, total: int, *columns: str) -> list:
    """At most ``n`` rows, the same on every run: of ``total`` rows some ``3 n`` are kept by hash where they lie,
    so the tasks together send a bounded number to the driver however many they are."""
    parts = max(1, total // (3 * n))
    kept = df.where(F.pmod(F.xxhash64(*columns), F.lit(parts)) == 0)
    return kept.orderBy(F.xxhash64(F.lit(1), *columns), *columns).limit(n).collect()
