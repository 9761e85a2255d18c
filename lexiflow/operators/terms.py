"""Key terms per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import text as T
from lexiflow.session import checkpointed, spread

LINK_FACTOR = 1.3


def counted_terms(text: Column, **how) -> Column:
    """array<struct<less, term>>: the terms of a text, two letters or more, most frequent first; less is minus the count.

    Tokens are split at hyphens. They are sorted and counted by their runs within the row, so
    nothing is shuffled.
    """
    toks = F.array_sort(F.filter(F.flatten(F.transform(T.tokens(text, **how), lambda t: F.split(t, "-"))), lambda t: F.length(t) >= 2))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda t, i: F.when((i == 0) | (F.get(s, i - 1) != t), i)), lambda i: i.isNotNull())
        return F.flatten(F.transform(F.array(starts), lambda at: F.transform(at, lambda b, j: F.struct((b - F.coalesce(F.get(at, j + 1), F.size(s))).cast("long").alias("less"), F.get(s, b).alias("term")))))

    # One lambda argument each for the sorted tokens and for the places where runs start, so neither is computed again.
    return F.array_sort(F.flatten(F.transform(F.array(toks), runs)))


def top_terms(docs: DataFrame, id_col: str, text_col: str, n: int, *keep: str, **how) -> DataFrame:
    """(id, kept columns, term, tf): of each row the ``n`` most frequent terms, equal counts by term.

    Every row is a document of its own. A null text has no terms.
    """
    base = spread(docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text")))
    rows = base.select("id", *keep, F.explode(F.slice(counted_terms(F.col("text"), **how), 1, n)).alias("t"))
    return rows.select("id", *keep, "t.term", (-F.col("t.less")).alias("tf"))


def key_terms(most: DataFrame, n: int, weights: DataFrame | None = None, linked: DataFrame | None = None) -> DataFrame:
    """``most`` (id, term, tf and more: the ``2 n`` most frequent terms) cut to the ``n`` of highest score, with score and rank.

    The score is the term's weight (``weights``: term, weight; 1 where missing), times 1.3 for a term
    that ``linked`` (term) holds. Equal scores, up to nine digits, are ordered by term.
    """
    rows = most.join(weights.select("term", "weight"), "term", "left") if weights is not None else most.withColumn("weight", F.lit(1.0))
    rows = rows.join(linked.select("term", F.lit(LINK_FACTOR).alias("factor")).distinct(), "term", "left") if linked is not None else rows.withColumn("factor", F.lit(1.0))
    scored = rows.withColumn("score", F.coalesce("weight", F.lit(1.0)) * F.coalesce("factor", F.lit(1.0))).drop("weight", "factor")
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("id").orderBy(F.desc(F.round("score", 9)), "term"))).where(F.col("rank") <= n)


def _term_counts(tokens, place: dict[str, int]) -> Iterator[np.ndarray]:
    """Dense counts (texts by terms) of lists of tokens, some hundred texts at a time."""
    size = len(place)
    for start in range(0, len(tokens), 500):
        some = tokens[start : start + 500]
        at = [i * size + place[t] for i, ts in enumerate(some) for t in ts if t in place]
        yield np.bincount(np.array(at, dtype=np.int64), minlength=len(some) * size).reshape(len(some), size).astype(float)


def tfidf_svd(docs: DataFrame, id_col: str, text_col: str, k: int = 50, vocabulary: int = 2000) -> DataFrame:
    """(id, components): the ``k`` components of a truncated SVD of the TF-IDF matrix; null where there are fewer than ``k`` terms.

    The vocabulary is the most frequent terms, equal counts by term. An axis points to where its largest weight is
    positive; components beyond the rank of the matrix are 0. A null text has no terms, and so components of 0.

    The tokens are written once. The products of the counts of any two terms, summed over all texts, are whole
    numbers, the same in any order; from them the driver, which holds vocabulary times vocabulary of them, has the axes.
    """
    split = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    rows = checkpointed(split.select("id", F.coalesce(T.tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens")))
    most = rows.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(vocabulary)
    place = {r["term"]: i for i, r in enumerate(most.collect())}
    size = len(place)
    if size < k:
        return rows.select("id", F.lit(None).cast("array<double>").alias("components"))

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Per part of the table a row for each term: its products with all terms; in the last row how many texts hold each."""
        total = np.zeros((size + 1, size))
        for b in batches:
            for x in _term_counts(b["tokens"].tolist(), place):
                total[:size] += x.T @ x
                total[size] += (x > 0).sum(axis=0)
        yield pd.DataFrame({"at": range(size + 1), "row": list(total)})

    def summed(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": [g["at"].iloc[0]], "row": [np.sum(g["row"].tolist(), axis=0)]})

    kind = "at int, row array<double>"
    whole = np.array([r["row"] for r in sorted(rows.select("tokens").mapInPandas(products, kind).groupBy("at").applyInPandas(summed, kind).collect(), key=lambda r: r["at"])])
    idf = np.log((rows.count() + 1) / (whole[size] + 1))
    values, vectors = np.linalg.eigh(idf[:, None] * whole[:size] * idf)
    axes = vectors[:, ::-1][:, :k] * (values[::-1][:k] > values[-1] * size * np.finfo(float).eps)
    axes *= np.where(axes[np.abs(axes).argmax(axis=0), range(k)] < 0, -1.0, 1.0)
    weights = idf[:, None] * axes

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "components": [c for x in _term_counts(b["tokens"].tolist(), place) for c in x @ weights]})

    return rows.mapInPandas(project, f"id {rows.schema['id'].dataType.simpleString()}, components array<double>")
