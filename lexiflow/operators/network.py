"""Concept networks as node and edge tables; undirected edges have source < target."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.operators.ontology import relation_similarity


def cooccurrence(terms: DataFrame, year_col: str = "year", relations: DataFrame | None = None) -> DataFrame:
    """(t1, t2, count, first_year, last_year, years, stability, match, weight), t1 < t2; weight = count * stability * match.

    ``stability`` grows by 0.01 a year between the first and the last; ``match`` is 1 and 0.2 more for each end that the first relations
    of both terms share (``relations``: concept, source, target), 1 where either has none.

    ``terms``: id, term, year; the terms of one document are a short list (top n), so their pairs
    are made inside one row's array, without a self-join.
    """
    lists = terms.groupBy("id", F.col(year_col).alias("year")).agg(F.array_sort(F.collect_set("term")).alias("terms"))
    pairs = F.flatten(F.transform("terms", lambda a, i: F.transform(F.slice("terms", i + 2, F.size("terms")), lambda b: F.struct(a.alias("t1"), b.alias("t2")))))
    rows = lists.select("year", F.explode(pairs).alias("p")).select("year", "p.t1", "p.t2")
    found = rows.groupBy("t1", "t2").agg(F.count("*").alias("count"), F.min("year").alias("first_year"), F.max("year").alias("last_year"), F.array_sort(F.collect_set("year")).alias("years"))
    stability = 1 + F.coalesce(F.col("last_year") - F.col("first_year"), F.lit(0)) * F.lit(0.01)
    found = found.withColumn("stability", stability)
    if relations is None:
        found = found.withColumn("match", F.lit(1.0))
    else:
        one, two = (relations.select(F.col("concept").alias(f"t{k}"), F.col("source").alias(f"s{k}"), F.col("target").alias(f"e{k}")) for k in (1, 2))
        match = relation_similarity(F.col("s1"), F.col("e1"), F.col("s2"), F.col("e2"))
        found = found.join(one, "t1", "left").join(two, "t2", "left").withColumn("match", match).drop("s1", "e1", "s2", "e2")
    return found.withColumn("weight", F.col("count") * F.col("stability") * F.col("match"))


def degrees(edges: DataFrame) -> DataFrame:
    """(term, degree): distinct partners."""
    return edges.select(F.explode(F.array("t1", "t2")).alias("term")).groupBy("term").agg(F.count("*").alias("degree"))


def normalised(edges: DataFrame) -> DataFrame:
    """(t1, t2, count, share): count by the sum of both degrees."""
    d = degrees(edges)
    both = edges.join(d.select(F.col("term").alias("t1"), F.col("degree").alias("d1")), "t1").join(d.select(F.col("term").alias("t2"), F.col("degree").alias("d2")), "t2")
    return both.select("t1", "t2", "count", (F.col("count") / (F.col("d1") + F.col("d2"))).alias("share"))


def text_concept_edges(terms: DataFrame, author_col: str, weights: DataFrame | None = None) -> DataFrame:
    """(author, term, weight): an author's texts to the concepts they name; the weight is the term's, 1 where missing."""
    rows = terms.select(F.col(author_col).alias("author"), "term").distinct()
    if weights is None:
        return rows.withColumn("weight", F.lit(1.0))
    return rows.join(weights.select("term", "weight"), "term", "left").select("author", "term", F.coalesce("weight", F.lit(1.0)).alias("weight"))


def induced(edges: DataFrame, nodes: DataFrame, least_weight: float | None = None) -> DataFrame:
    """Edges of which both ends are in ``nodes`` (term), of more than ``least_weight``."""
    kept = edges.join(nodes.select(F.col("term").alias("t1")).distinct(), "t1", "left_semi").join(nodes.select(F.col("term").alias("t2")).distinct(), "t2", "left_semi")
    return kept if least_weight is None else kept.where(F.col("weight") > least_weight)


def unique_patterns(edges: DataFrame, focal_terms: DataFrame, k: int = 5) -> DataFrame:
    """(concept, rank, connection, weight, years): the ``k`` heaviest connections of each focal concept; ties by name."""
    ends = edges.select(F.col("t1").alias("concept"), F.col("t2").alias("connection"), "weight", "years").unionAll(edges.select(F.col("t2"), F.col("t1"), "weight", "years"))
    own = ends.join(focal_terms.select(F.col("term").alias("concept")).distinct(), "concept", "left_semi")
    return own.withColumn("rank", F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("weight"), "connection"))).where(F.col("rank") <= k).select("concept", "rank", "connection", "weight", "years")


def neighbours(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(term): every node that an edge joins to one of ``nodes`` (term), each once."""
    ends = edges.select(F.col("t1").alias("term"), F.col("t2").alias("other")).unionAll(edges.select(F.col("t2"), F.col("t1")))
    return ends.join(nodes.select("term").distinct(), "term", "left_semi").select(F.col("other").alias("term")).distinct()


def patterns_by_shift(focal_terms: DataFrame, weights: DataFrame, relations: DataFrame) -> DataFrame:
    """(concept, transformation, source, target) of the focal concepts, most transformed first; 1 where a concept has no index, null where it has no relation."""
    rows = focal_terms.select(F.col("term").alias("concept")).distinct().join(weights.select(F.col("term").alias("concept"), F.col("weight").alias("transformation")), "concept", "left")
    rows = rows.join(relations.select("concept", "source", "target"), "concept", "left").withColumn("transformation", F.coalesce("transformation", F.lit(1.0)))
    return rows.orderBy(F.desc(F.round("transformation", 9)), "concept").select("concept", "transformation", "source", "target")


def last_attributes(texts: DataFrame, author_col: str, year_col: str, id_col: str) -> DataFrame:
    """(author, year): an author node has the year of its last text, by (year, id)."""
    return texts.groupBy(F.col(author_col).alias("author")).agg(F.max(F.struct(F.col(year_col).alias("year"), F.col(id_col).alias("id"))).alias("m")).select("author", "m.year")
