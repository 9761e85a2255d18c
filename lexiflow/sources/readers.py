"""Batch sources: text trees, encodings, JSON and JSON lines, inventories, candidate paths."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T

CORRUPT = "_corrupt"


def text_tree(spark: SparkSession, path: str, suffix: str = ".txt", case_sensitive: bool = False) -> DataFrame:
    """(path, text): whole files of a directory tree, newlines and byte-order marks normalised."""
    name = f"*{suffix}" if case_sensitive else "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), T.normalise_newlines(F.col("value")).alias("text"))


def decoded_tree(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(path, text, encoding): files decoded by a sniff of their first 50,000 bytes.

    UTF-8 wherever the sample is valid UTF-8; else windows-1251 or ISO 8859-5, whichever makes more of the
    sample lower-case Cyrillic; else UTF-8 with replacement characters.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            names = [sniff(bytes(c)) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": [bytes(c).decode(n, "replace") for c, n in zip(b["content"], names)], "encoding": names})

    return files.mapInPandas(decode, "path string, text string, encoding string").withColumn("text", T.normalise_newlines(F.col("text")))


def sniff(content: bytes, sample: int = 50_000) -> str:
    head = content[:sample]
    try:
        head[: len(head) if len(content) <= sample else len(head) - 4].decode("utf-8")
        return "utf-8"
    except UnicodeDecodeError as e:
        if e.start >= len(head) - 4 and len(content) > 4:
            return "utf-8"
    share = {n: sum("а" <= c <= "я" for c in head.decode(n, "replace")) / max(1, len(head)) for n in ("cp1251", "iso8859-5")}
    best = max(share, key=share.get)
    return best if share[best] > 0.3 else "utf-8"


def decoded_or_latin(spark: SparkSession, path: str, suffix: str = ".txt") -> DataFrame:
    """(path, text, encoding): files read as UTF-8, and as Latin-1 if they are no valid UTF-8."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path).select("path", "content")
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return files.select("path", T.normalise_newlines(text).alias("text"), F.when(valid, "utf-8").otherwise("latin-1").alias("encoding"))


def json_documents(spark: SparkSession, path: str, schema: str, defaults: dict | None = None) -> DataFrame:
    """Whole-file JSON documents by an explicit schema; missing fields take the defaults; unreadable files give rows with ``_corrupt``."""
    rows = spark.read.schema(f"{schema}, {CORRUPT} string").option("multiLine", "true").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return rows.fillna(defaults) if defaults else rows


def json_sequence(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON texts of any layout parted by record separators; an unreadable text gives a row of nulls."""
    rows = spark.read.option("lineSep", "\x1e").text(path).where(F.col("value").rlike(r"\S"))
    return rows.select(F.from_json("value", schema).alias("d")).select("d.*")


def json_lines(spark: SparkSession, path: str, schema: str, bad: str = "skip") -> DataFrame:
    """One object a line. ``bad`` lines: ``skip`` them, ``keep`` them in ``_corrupt``, or ``fail``."""
    mode = {"skip": "DROPMALFORMED", "keep": "PERMISSIVE", "fail": "FAILFAST"}[bad]
    schema = f"{schema}, {CORRUPT} string" if bad == "keep" else schema
    return spark.read.schema(schema).option("mode", mode).option("columnNameOfCorruptRecord", CORRUPT).json(path)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", "true").csv(path)


def inventory(spark: SparkSession, path: str, without: tuple[str, ...] = (".git", "__pycache__", "node_modules")) -> DataFrame:
    """(path, bytes, modified) of the files below a directory; hidden and excluded directories are left out. Contents aren't read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    hidden = F.col("path").rlike(r"/\.[^/]+/") | F.lit(False)
    for name in without:
        hidden = hidden | F.contains("path", F.lit(f"/{name}/"))
    return rows.where(~hidden)


def concatenated(tree: DataFrame, extensions: tuple[str, ...] = (".txt", ".md", ".py")) -> DataFrame:
    """(path, block): each file of the allowed extensions under a header line with its path."""
    allowed = F.lit(False)
    for e in extensions:
        allowed = allowed | F.lower("path").endswith(e)
    return tree.where(allowed).select("path", F.concat(F.lit("=== "), "path", F.lit(" ===\n"), "text", F.lit("\n")).alias("block"))


def first_existing(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(volume, path): of each volume its candidate path of least priority that exists. ``wanted``: volume, path, priority."""
    w = Window.partitionBy("volume").orderBy("priority")
    return wanted.join(files.select("path").distinct(), "path", "left_semi").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("volume", "path")
