"""Concept dictionaries: matching, carried-forward concepts, relations, combined stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import lexicon
from lexiflow.functions import text as T
from lexiflow.session import spread


def _held(text: Column, terms: dict[str, list[str]]) -> Column:
    """Array of the concepts, in dictionary order, of which a term occurs in the text; both sides in lower case."""
    low = F.lower(text)
    hits = []
    for concept, words in terms.items():
        any_ = F.lit(False)
        for w in dict.fromkeys([concept, *words]):
            any_ = any_ | F.contains(low, F.lit(w.lower()))
        hits.append(F.when(any_, F.lit(concept)))
    return F.array_compact(F.array(*hits))


def thesaurus_match(docs: DataFrame, id_col: str, text_col: str, terms: dict[str, list[str]] = lexicon.THESAURUS) -> DataFrame:
    """(id, concept): concepts named in a text, each once. The dictionary is part of the plan, so nothing is joined."""
    return spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", F.explode(_held(F.col("text"), terms)).alias("concept")).distinct()


def sentence_concepts(docs: DataFrame, id_col: str, text_col: str, terms: dict[str, list[str]] = lexicon.THESAURUS) -> DataFrame:
    """(id, pos, sentence, concept, own): sentences under their concept.

    The first concept of the dictionary that a sentence names is its own; a sentence without one
    carries the last before it in its text; leading sentences without one are left out.
    """
    base = spread(docs.select(F.col(id_col).alias("id"), T.sentences(F.col(text_col)).alias("sents")))
    rows = base.select("id", F.posexplode("sents").alias("pos", "sentence")).withColumn("own_concept", F.try_element_at(_held(F.col("sentence"), terms), F.lit(1)))
    carried = F.last("own_concept", ignorenulls=True).over(Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return rows.select("id", "pos", "sentence", carried.alias("concept"), F.col("own_concept").isNotNull().alias("own")).where("concept is not null")


def first_relation(relations: DataFrame, concepts: DataFrame, position: str | None = None) -> DataFrame:
    """(concept, source, target, strength): per concept its first relation by ``position``, whichever end it is; without a position the strongest.

    Both ends are exploded, so the join is an equi-join; ties go to the lesser source, then target.
    """
    place = F.col(position) if position else -F.col("strength")
    ends = relations.select("source", "target", "strength", place.alias("place"), F.explode(F.array_distinct(F.array("source", "target"))).alias("concept"))
    best = ends.join(concepts.select("concept").distinct(), "concept", "left_semi").groupBy("concept").agg(F.min(F.struct("place", "source", "target", "strength")).alias("b"))
    return best.select("concept", "b.source", "b.target", "b.strength")


def relation_similarity(source_a: Column, target_a: Column, source_b: Column, target_b: Column) -> Column:
    """1 + 0.2 for each of a's ends that b has too; 1 if either relation is missing."""
    same = ((source_a == source_b) | (source_a == target_b)).cast("int") + ((target_a == target_b) | (target_a == source_b)).cast("int")
    return F.coalesce(1 + same * F.lit(0.2), F.lit(1.0))


def combine_stages(concepts: DataFrame, analysed: DataFrame) -> DataFrame:
    """(concept, transformation_index, occurrences, analysed): every concept, 1.0 and 0 where it wasn't analysed."""
    return concepts.select("concept").distinct().join(analysed.select("concept", "transformation_index", "occurrences"), "concept", "left").select(
        "concept", F.coalesce("transformation_index", F.lit(1.0)).alias("transformation_index"), F.coalesce("occurrences", F.lit(0).cast("long")).alias("occurrences"), F.col("transformation_index").isNotNull().alias("analysed")
    )
