"""Occurrences of literal terms with their places and contexts, and the shift of a concept's contexts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import vectors as V
from lexiflow.session import spread


def find_occurrences(docs: DataFrame, id_col: str, text_col: str, terms: list[str], around: int = 100) -> DataFrame:
    """(id, term, occurrence, start, end, context): non-overlapping hits of each term, case left aside.

    One pass over a text per term, linear in its length. ``terms`` is a stated, short list. Where lower
    case changes a text's length, places refer to the lower-case text. Empty terms and null texts have
    no hits; repeated rows give repeated hits.
    """
    base = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).where("text is not null")
    wanted = [t.lower() for t in terms if t]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text in zip(b["id"], b["text"]):
                low = text.lower()
                seen = text if len(low) == len(text) else low
                for term in wanted:
                    at, n = low.find(term), 0
                    while at >= 0:
                        end = at + len(term)
                        rows.append((key, term, n, at, end, seen[max(0, at - around) : end + around]))
                        at, n = low.find(term, end), n + 1
            yield pd.DataFrame(rows, columns=["id", "term", "occurrence", "start", "end", "context"])

    return base.mapInPandas(find, f"id {base.schema['id'].dataType.simpleString()}, term string, occurrence int, start int, end int, context string")


def sample_per(rows: DataFrame, by: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` rows per group by seeded hash order; the same rows on every run."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(F.lit(seed), F.col(key).cast("string")), key))).where(F.col("_place") <= n).drop("_place")


def shift_index(vectors: DataFrame, originals: DataFrame, least: int = 5) -> DataFrame:
    """(concept, transformation_index, occurrences): 1 - mean cosine of a concept's contexts with its original vector.

    ``vectors``: concept, vector; ``originals``: concept, vector, one row each. Concepts of fewer than ``least`` contexts
    are left out; an original without direction gives 1. Partial means before the shuffle.
    """
    own = originals.select("concept", F.col("vector").alias("original"))
    rows = vectors.join(own, "concept").withColumn("cos", F.coalesce(V.cosine(F.col("vector"), F.col("original")), F.lit(0.0)))
    return rows.groupBy("concept").agg((1 - F.avg("cos")).alias("transformation_index"), F.count("*").alias("occurrences")).where(F.col("occurrences") >= least)


def top_shifted(shift: DataFrame, n: int = 10) -> DataFrame:
    return shift.orderBy(F.desc("transformation_index"), "concept").limit(n)


def section_index(sections: DataFrame, id_col: str, concepts_col: str, k: int = 50) -> DataFrame:
    """(id, section_index): the mean of a section's ``k`` highest concept similarities; sections without concepts are left out."""
    best = F.slice(F.sort_array(F.transform(concepts_col, lambda c: c["similarity"]), asc=False), 1, k)
    rows = sections.select(F.col(id_col).alias("id"), best.alias("best")).where(F.size("best") > 0)
    return rows.select("id", (F.aggregate("best", F.lit(0.0), lambda s, x: s + x) / F.size("best")).alias("section_index"))
