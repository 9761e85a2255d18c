"""Similarity joins and nearest neighbours over vector columns, block against block in numpy.

Both sides are cut into blocks of bounded size by a hash of their ids; every pair of blocks that has to meet is one
group of a co-grouped join. Nothing is collected or broadcast but the two row counts.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.functions import vectors as V
from lexiflow.session import spread

BLOCK = 4_000


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 1))


def unit_rows(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, v): unit vectors of one width as array<double>; anything without a direction is left out."""
    rows = spread(df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("raw"))).where(V.is_vector(F.col("raw"))).select("id", V.align_width(F.col("raw"), width).alias("v"))
    return rows.where(V.norm(F.col("v")) > 0).select("id", F.transform("v", lambda x: x.cast("double") / V.norm(F.col("v"))).alias("v"))


def _met(df: DataFrame, own: str, blocks: int, other: str, others: int) -> DataFrame:
    """Every row in its own block, once for each block of the other side."""
    rows = df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    return rows.withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def top_k(stated: DataFrame, others: DataFrame, k: int, id_type: str = "bigint", block: int = BLOCK) -> DataFrame:
    """(id, other, cosine, rank): of every stated row the ``k`` most similar others, itself left out; ties by the lesser id.

    ``stated`` and ``others`` have (id, v) of ``unit_rows``. Each pair of blocks sends at most ``k`` rows per stated row.
    """
    a, b = max(1, math.ceil(stated.count() / block)), max(1, math.ceil(others.count() / block))
    left, right = _met(stated, "a", a, "b", b), _met(others, "b", b, "a", a)

    def best(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"id": [], "other": [], "cosine": []})
        ids, other = x["id"].to_numpy(), y["id"].to_numpy()
        cos = _stack(x["v"]) @ _stack(y["v"]).T
        cos[ids[:, None] == other[None, :]] = -np.inf
        order = np.lexsort((np.broadcast_to(other, cos.shape), -np.round(cos, 9)), axis=1)[:, :k]
        who, at = np.repeat(np.arange(len(ids)), order.shape[1]), order.ravel()
        keep = np.isfinite(cos[who, at])
        return pd.DataFrame({"id": ids[who[keep]], "other": other[at[keep]], "cosine": cos[who[keep], at[keep]]})

    found = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(best, f"id {id_type}, other {id_type}, cosine double")
    ranked = found.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.round("cosine", 9)).alias("far"), "other", "cosine"))), 1, k).alias("best"))
    return ranked.select("id", F.posexplode("best").alias("at", "b")).select("id", F.col("b.other").alias("other"), F.col("b.cosine").alias("cosine"), (F.col("at") + 1).alias("rank"))


def related_within(rows: DataFrame, threshold: float, group_type: str = "string", id_type: str = "bigint", block: int = 1_000) -> DataFrame:
    """(group, a, b, cosine), a < b: pairs of one document's concepts with a cosine above ``threshold``.

    ``rows`` has (group, id, v), v a unit vector. Ids may come in many groups, once in each. A group of any size
    is cut into blocks that meet pairwise, so it is never one task's work.
    """
    blocks = rows.groupBy("group").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    own = rows.join(blocks, "group").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = own.select("group", "id", "v", "own", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"))

    def above(g: pd.DataFrame) -> pd.DataFrame:
        i, j = int(g["i"].iloc[0]), int(g["j"].iloc[0])
        x, y = g[g["own"] == i], g[g["own"] == j]
        if not len(x) or not len(y):
            return pd.DataFrame({"group": [], "a": [], "b": [], "cosine": []})
        p, q = x["id"].to_numpy(), y["id"].to_numpy()
        cos = _stack(x["v"]) @ _stack(y["v"]).T
        near = (cos > threshold) & ((p[:, None] < q[None, :]) if i == j else (p[:, None] != q[None, :]))
        s, t = np.nonzero(near)
        return pd.DataFrame({"group": g["group"].iloc[0], "a": np.minimum(p[s], q[t]), "b": np.maximum(p[s], q[t]), "cosine": cos[s, t]})

    return met.groupBy("group", "i", "j").applyInPandas(above, f"group {group_type}, a {id_type}, b {id_type}, cosine double")


def context(neighbours: DataFrame, documents: DataFrame, id_col: str, text_col: str, limit: int = 500) -> DataFrame:
    """(id, context): the texts of a query's neighbours in rank order, joined by a space and cut."""
    named = neighbours.join(documents.select(F.col(id_col).alias("other"), F.col(text_col).alias("text")), "other")
    return named.groupBy("id").agg(F.left(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), " "), F.lit(limit)).alias("context"))
