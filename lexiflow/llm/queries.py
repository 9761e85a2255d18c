"""The pN_ queries, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.llm import p1_similar_vectors as p1
from lexiflow.llm import p2_near_duplicates as p2
from lexiflow.llm import p3_splitting as p3
from lexiflow.llm import p4_scan_noise as p4
from lexiflow.llm import p5_truncation as p5
from lexiflow.llm import p6_repeated_lines as p6
from lexiflow.llm import p7_broken_pairs as p7
from lexiflow.llm import p8_evaluation_leaks as p8
from lexiflow.llm import p9_mixing as p9
from lexiflow.llm import p10_residue as p10
from lexiflow.llm.common import table
from lexiflow.llm.sql import oracle_sql  # noqa: F401

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    near = p1.most_similar(table(spark, d, "concept_vectors"), "vec_id", "embedding", min_cosine=0.9)
    return near.select(F.least("id", "other").alias("vec_id_a"), F.greatest("id", "other").alias("vec_id_b")).distinct()


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every vector whose id is divisible by 50, against all."""
    vectors = table(spark, d, "concept_vectors")
    return p1.most_similar(vectors, "vec_id", "embedding", queries=vectors.where("vec_id % 50 = 0").select("vec_id"), probes=128)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = p2.near_duplicate_pairs(table(spark, d, "news"), "id", "content", order_col="created_at", similarity=0.6, min_words=60)
    return pairs.select(F.col("id_a").alias("news_id_a"), F.col("id_b").alias("news_id_b"))


def p2_news_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row per item, short ones and those without words included."""
    return p2.near_duplicate_links(table(spark, d, "news"), "id", "content", order_col="created_at", similarity=0.6, every=True)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    sections = p3.forced_items(table(spark, d, "sections"), "section_id", "section_text").select(F.lit("section").alias("item_kind"), F.col("id").alias("item_id"))
    contexts = p3.forced_items(table(spark, d, "occurrences"), "occ_id", "context").select(F.lit("context").alias("item_kind"), F.col("id").cast("string").alias("item_id"))
    return sections.unionAll(contexts)


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    sections = p3.split_pieces(table(spark, d, "sections"), "section_id", "section_text", only_longer=True).withColumn("item_kind", F.lit("section"))
    contexts = p3.split_pieces(table(spark, d, "occurrences").dropDuplicates(["occ_id"]).withColumn("occ_id", F.col("occ_id").cast("string")), "occ_id", "context", only_longer=True).withColumn("item_kind", F.lit("context"))
    return sections.unionByName(contexts)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return p4.scan_noise(table(spark, d, "sections"), "section_id", "section_text", "volume_id").select(F.col("id").alias("section_id"), "noise")


def p4_repaired(spark: SparkSession, d: str) -> DataFrame:
    return p4.repaired(table(spark, d, "sections"), "section_id", "section_text", "volume_id")


def _news_sources(spark: SparkSession, d: str) -> DataFrame:
    """(id, source): of each news id its first row's source."""
    return table(spark, d, "news").where("id is not null").groupBy("id").agg(F.min_by("source", "created_at").alias("source"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Analyses by news source and responses by model, judged together: one corpus, one model of endings."""
    analyses = table(spark, d, "analysis").join(_news_sources(spark, d).withColumnRenamed("id", "news_id"), "news_id", "left")
    a = analyses.where("news_id is not null").select(F.struct(F.lit("analysis").alias("kind"), F.col("news_id").alias("key")).alias("id"), F.col("analysis").alias("text"), "source", F.lit(None).cast("int").alias("most"))
    runs = table(spark, d, "parameter_results").where("run_id is not null")
    r = runs.select(F.struct(F.lit("run").alias("kind"), F.col("run_id").cast("string").alias("key")).alias("id"), F.col("response").alias("text"), F.col("model_name").alias("source"), F.col("max_tokens").cast("int").alias("most"))
    return p5.truncation(a.unionAll(r), "id", "text", "source", limit_col="most")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).where("truncated").select(F.col("id.kind").alias("record_kind"), F.col("id.key").alias("record_id")).distinct()


def p5_by_source(spark: SparkSession, d: str) -> DataFrame:
    return p5.truncation_report(_judged(spark, d).where("id.kind = 'analysis'"))


def p5_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Per model and max_tokens: how often its responses are cut."""
    runs = table(spark, d, "parameter_results").select(F.col("run_id").cast("string").alias("key"), "model_name", "max_tokens").distinct()
    judged = _judged(spark, d).where("id.kind = 'run'").groupBy(F.col("id.key").alias("key")).agg(F.max("truncated").alias("truncated"))
    shares = runs.join(judged, "key").groupBy("model_name", "max_tokens").agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated"))
    return shares.withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    found = p6.repeated_lines(table(spark, d, "news"), "id", "content", "source")
    return found.select(F.col("id").alias("news_id"), "line_no").distinct()


def p6_blocks(spark: SparkSession, d: str) -> DataFrame:
    return p6.boilerplate_blocks(table(spark, d, "news"), "id", "content", "source")


def p6_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return p6.without_repeated_lines(table(spark, d, "news"), "id", "content", "source")


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Questions and answers with the evidence of the answers' endings; texts are shuffled by id once."""
    news = table(spark, d, "news").where("id is not null")
    first = news.groupBy("id").agg(F.min("created_at").alias("first"))
    asked = news.join(first, "id").where(F.col("created_at").eqNullSafe(F.col("first"))).select("id", F.concat_ws("\n", "title", "content").alias("question"))
    judged = _judged(spark, d).groupBy("id", "text_key").agg(*[F.min(c).alias(c) for c in ("mark", "last_word")], F.max("at_limit").alias("at_limit"))
    of = lambda kind: judged.where(F.col("id.kind") == kind).select(F.col("id.key").alias("id"), F.col("text_key").alias("judged_key"), "mark", "last_word", "at_limit")
    answers = table(spark, d, "analysis").select(F.col("news_id").alias("id"), F.col("analysis").alias("answer"), F.xxhash64("analysis").alias("key"))
    a = asked.join(answers, "id").join(of("analysis"), "id").where("key = judged_key").select(F.lit("analysis").alias("pair_kind"), F.col("id").alias("pair_id"), "question", "answer", "mark", "last_word", "at_limit")
    runs = table(spark, d, "parameter_results").select(F.col("run_id").cast("string").alias("id"), F.col("prompt").alias("question"), F.col("response").alias("answer"), F.xxhash64("response").alias("key"))
    r = runs.join(of("run"), "id").where("key = judged_key").select(F.lit("run").alias("pair_kind"), F.col("id").alias("pair_id"), "question", "answer", "mark", "last_word", "at_limit")
    return a.unionAll(r)


def _broken(spark: SparkSession, d: str) -> DataFrame:
    return p7.broken_pairs(_pairs(spark, d), table(spark, d, "documents").select("text", "lang"))


def p7_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Per defect: pairs kept, pairs where the label model overrules the first function, cutoff, and the figures on planted pairs."""
    return p7.agreement(_pairs(spark, d), table(spark, d, "documents").select("text", "lang"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).select("pair_kind", "pair_id", "defect")


def p7_defect_counts(spark: SparkSession, d: str) -> DataFrame:
    return _broken(spark, d).groupBy("pair_kind", "defect").agg(F.count("*").alias("pairs"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p8_without_leaks(spark: SparkSession, d: str) -> DataFrame:
    return p8.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def _mix(spark: SparkSession, d: str, **how) -> tuple[DataFrame, DataFrame]:
    return p9.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"), "doc_id", "text", "source", **how)


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mixture in which every source that has documents holds its target share."""
    return _mix(spark, d)[0].withColumnRenamed("id", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def p9_shares_full(spark: SparkSession, d: str) -> DataFrame:
    """Shares of a mixture as large as the listed sources' tokens: capped sources run out and the others fill up."""
    return _mix(spark, d, of_corpus=1.0)[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10.residue(table(spark, d, "documents"), "doc_id", "text").select(F.col("id").alias("doc_id"), "residue")


def p10_report(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: documents with residue, and how many are residue for the better part."""
    found = p10.residue(table(spark, d, "documents"), "doc_id", "text")
    return found.groupBy("residue").agg(F.count("*").alias("documents"), F.count_if(F.col("coverage") >= 0.5).alias("mostly_residue"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """The documents to keep, with the kind of residue that stands within their content."""
    return p10.without_residue(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def queries() -> dict[str, Query]:
    return {k: v for k, v in sorted(globals().items()) if k[0] == "p" and k[1:2].isdigit() and "_" in k and callable(v)}
