"""Sinks: JSON, JSON lines, CSV, text reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Fixed value: the record separator of JSON text sequences.
RECORD = "\x1e"


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_document(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Each row as one pretty JSON text behind a record separator (JSON text sequence); letters outside ASCII are kept."""
    df.select(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"pretty": "true"}).alias("value")).write.mode(mode).option("lineSep", RECORD).text(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("header", "true").csv(path)


def write_report(df: DataFrame, path: str, template: str, *columns: str, mode: str = "errorifexists") -> None:
    """One formatted line per row."""
    df.select(F.format_string(template, *[F.col(c) for c in columns]).alias("value")).write.mode(mode).text(path)


def write_collection(df: DataFrame, path: str, id_col: str, by: str | None = None, mode: str = "overwrite") -> None:
    """A vector collection: one row per id, rebuilt as a whole, partitioned by ``by``."""
    out = df.dropDuplicates([id_col]).write.mode(mode)
    (out.partitionBy(by) if by else out).parquet(path)
