"""Lines that a source puts into its items over and over.

The lines of a source are the nodes of a weighted graph; an edge joins two lines that follow one
another in an item. A node's or edge's weight is the number of distinct items that hold it. Nodes
(and edges between them) of high support are kept, the connected components are the source's
boilerplate blocks, and every occurrence of their lines can be deleted from the items.

Two lines are the same if they agree in their letters; case, digits, punctuation and spaces are
left aside, and lines without letters are no nodes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, col, spread

MIN_ITEMS, MIN_SHARE = 5, 0.05


def line_key(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


def _lines(df: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(source, id, line_no, line, node, after): after is the node of the next line with letters, or null."""
    base = spread(df.select(col(id_col).alias("id"), col(text_col).alias("text"), col(source_col).alias("source"))).where("id is not null and source is not null and text is not null")
    rows = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("line_no"), x.alias("line"), line_key(x).alias("key")))
    kept = base.select("source", "id", F.filter(rows, lambda r: r["key"] != "").alias("rows"))
    linked = F.transform("rows", lambda r, i: F.struct(r["line_no"].alias("line_no"), r["line"].alias("line"), F.xxhash64(r["key"]).alias("node"), F.xxhash64(F.try_element_at("rows", i + 2)["key"]).alias("after"), (i + 1 < F.size("rows")).alias("more")))
    return kept.select("source", "id", F.explode(linked).alias("r")).select("source", "id", "r.line_no", "r.line", "r.node", F.when(F.col("r.more"), F.col("r.after")).alias("after"))


def _components(nodes: pd.DataFrame) -> pd.DataFrame:
    """Components of one source. Its kept nodes are at most mean lines per item / min_share, so it fits a task."""
    parent: dict[int, int] = {n: n for n in nodes["node"]}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for n, others in zip(nodes["node"], nodes["edges"]):
        for o in others if others is not None else ():
            if o in parent and (a := root(n)) != (b := root(o)):
                parent[max(a, b)] = min(a, b)
    return pd.DataFrame({"source": nodes["source"], "node": nodes["node"], "block": [root(n) for n in nodes["node"]], "items": nodes["items"], "sample": nodes["sample"]})


def boilerplate_blocks(df: DataFrame, id_col: str, text_col: str, source_col: str, *, min_items: int = MIN_ITEMS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, node, block, items, sample): the lines repeated excessively, with their block.

    Kept are lines found in at least ``min_items`` distinct ids and at least ``min_share`` of all
    distinct ids of the source. Rows with a null id, source or text hold no lines (a null text still
    counts as an item of its source); repeated rows of an id count once. ``sample`` is the least of
    the line's spellings. An empty table gives an empty result.
    """
    lines = _lines(df, id_col, text_col, source_col)
    return _blocks(checkpointed(lines.drop("line")), df, id_col, source_col, min_items, min_share, lines)


def _blocks(lines: DataFrame, df: DataFrame, id_col: str, source_col: str, min_items: int, min_share: float, sample: DataFrame | None = None) -> DataFrame:
    total = df.select(F.xxhash64(col(id_col)).alias("item"), col(id_col).alias("id"), col(source_col).alias("source")).where("id is not null and source is not null").select("source", "item").distinct().groupBy("source").agg(F.count("*").alias("total"))
    counted = lines.select("source", "node", F.xxhash64("id").alias("item")).distinct().groupBy("source", "node").agg(F.count("*").alias("items"))
    # Written, as the next steps read them three times, and so that their size is known when joins are planned:
    # a source has at most mean lines per item / min_share nodes.
    nodes = checkpointed(counted.where(F.col("items") >= min_items).join(total, "source").where(F.col("items") >= F.col("total") * min_share - 1e-9).select("source", "node", "items"))
    ends = nodes.select("source", "node")
    samples = nodes.withColumn("sample", F.lit(None).cast("string")) if sample is None else sample.join(nodes, ["source", "node"]).groupBy("source", "node").agg(F.first("items").alias("items"), F.min("line").alias("sample"))
    edges = lines.where("after is not null").join(ends, ["source", "node"], "left_semi").join(ends.withColumnRenamed("node", "after"), ["source", "after"], "left_semi").select("source", "node", "after", F.xxhash64("id").alias("item"))
    heavy = edges.distinct().groupBy("source", "node", "after").agg(F.count("*").alias("items")).where(F.col("items") >= min_items).groupBy("source", "node").agg(F.collect_list("after").alias("edges"))
    graph = samples.join(heavy, ["source", "node"], "left")
    return checkpointed(graph.groupBy("source").applyInPandas(_components, "source string, node long, block long, items long, sample string"))


def repeated_lines(df: DataFrame, id_col: str, text_col: str, source_col: str, *, min_items: int = MIN_ITEMS, min_share: float = MIN_SHARE) -> DataFrame:
    """(id, line_no, source, block): every occurrence of a boilerplate line; line_no counts from 0, blank lines included."""
    # Texts are split once; written are hashes of the lines.
    lines = checkpointed(_lines(df, id_col, text_col, source_col).drop("line"))
    blocks = _blocks(lines, df, id_col, source_col, min_items, min_share).select("source", "node", "block")
    return lines.join(blocks, ["source", "node"]).select("id", "line_no", "source", "block").distinct()


def without_repeated_lines(df: DataFrame, id_col: str, text_col: str, source_col: str, **limits) -> DataFrame:
    """(id, source, text, removed): every row of ``df`` with its text less the boilerplate lines.

    Rows with a null id, text or source come out unchanged, with 0 removed. Repeated rows stay.
    """
    found = repeated_lines(df, id_col, text_col, source_col, **limits).groupBy("id", "source").agg(F.collect_set("line_no").alias("drop"))
    base = df.select(col(id_col).alias("id"), col(source_col).alias("source"), col(text_col).alias("text"))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("drop", i)), "\n")
    return base.join(found, ["id", "source"], "left").select("id", "source", F.when(F.col("drop").isNull(), F.col("text")).otherwise(left).alias("text"), F.coalesce(F.array_size("drop"), F.lit(0)).alias("removed"))
