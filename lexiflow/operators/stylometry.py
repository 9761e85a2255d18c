"""Stylometric profiles, their similarity and their drift over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.functions import lexicon
from lexiflow.functions import text as T
from lexiflow.session import spread

#: Length of the id ranges into which a group and year are cut.
RANGE = 50_000
SCALARS = ("sentence_length", "lexical_diversity", "word_length", "paragraph_length")


def _mean(parts: Column, size_of) -> Column:
    total = F.aggregate(parts, F.lit(0), lambda s, p: s + size_of(p))
    return F.coalesce(F.try_divide(total.cast("double"), F.size(parts)), F.lit(0.0))


def profiles(docs: DataFrame, id_col: str, text_col: str, *keep: str) -> DataFrame:
    """(id, kept columns, sentence and word counts, four scalars, six counts of marks).

    Per row, without a shuffle. A text without words has a null profile.
    """
    base = spread(docs.select(F.col(id_col).alias("id"), *keep, F.col(text_col).alias("text")))
    parts = base.select("*", T.sentences(F.col("text")).alias("sents"), T.split_words(F.col("text")).alias("words"), T.paragraphs(F.col("text")).alias("paras"))
    some = F.size("words") > 0
    columns = {
        "n_words": F.size("words"),
        "n_sentences": F.size("sents"),
        "sentence_length": _mean(F.col("sents"), lambda s: F.size(T.split_words(s))),
        "lexical_diversity": F.try_divide(F.size(F.array_distinct("words")).cast("double"), F.size("words")),
        "word_length": _mean(F.col("words"), F.length),
        "paragraph_length": _mean(F.col("paras"), lambda p: F.size(F.split(p, "[.!?]"))),
        "comma": T.count_of(F.col("text"), ","),
        "semicolon": T.count_of(F.col("text"), ";"),
        "colon": T.count_of(F.col("text"), ":"),
        "dash": T.count_of(F.col("text"), "—"),
        "quote": T.count_of(F.col("text"), '"', "'"),
        "parenthesis": T.count_of(F.col("text"), "(", ")"),
    }
    return parts.select("id", *keep, *[F.when(some, c).alias(n) for n, c in columns.items()])


def function_word_shares(docs: DataFrame, id_col: str, text_col: str, *keep: str, words: list[str] = lexicon.FUNCTION_WORDS) -> DataFrame:
    """(id, kept columns, word, share): of all words, case kept; every word of the list for every text with words."""
    base = spread(docs.select(F.col(id_col).alias("id"), *keep, T.split_words(F.col(text_col)).alias("words"))).where(F.size("words") > 0)

    def share(word: str) -> Column:
        return F.struct(F.lit(word).alias("word"), (F.size(F.filter("words", lambda x: x == F.lit(word))).cast("double") / F.size("words")).alias("share"))

    shares = F.array(*[share(w) for w in words])
    return base.select("id", *keep, F.explode(shares).alias("s")).select("id", *keep, "s.*")


def mean_profiles(profile: DataFrame, by: str) -> DataFrame:
    """(by, documents, means of the scalars); null profiles are left out."""
    return profile.where(F.col("n_words") > 0).groupBy(by).agg(F.count("*").alias("documents"), *[F.avg(c).alias(c) for c in SCALARS])


def mean_shares(shares: DataFrame, by: str) -> DataFrame:
    """(by, shares): the mean share of every function word in a group, as a map."""
    means = shares.groupBy(by, "word").agg(F.avg("share").alias("share"))
    return means.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("word", "share")))).alias("shares"))


def style_similarity(a: dict[str, Column], b: dict[str, Column], function_words: Column) -> tuple[Column, Column]:
    """(clamped to 0..1, unclamped) weighted similarity of two profiles."""
    total = function_words * lexicon.FUNCTION_WORD_WEIGHT
    for part, (weight, scale) in lexicon.STYLE_PARTS.items():
        total = total + (1 - F.abs(a[part] - b[part]) / scale) * weight
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total)), total


def compare_to(means: DataFrame, shares: DataFrame, by: str, focal) -> DataFrame:
    """(by, similarity, unclamped): every group's style against the focal group's, a single row."""
    word_means = shares.groupBy(by, "word").agg(F.avg("share").alias("share"))
    own = word_means.where(F.col(by) == focal).select("word", F.col("share").alias("f"))
    alike = word_means.join(F.broadcast(own), "word").groupBy(by).agg(F.avg(1 - F.abs(F.col("share") - F.col("f"))).alias("words_alike"))  # one row per function word
    # The focal group's means beside every group's: over one row per group.
    w = Window.partitionBy(F.lit(0))
    own_means = [F.max(F.when(F.col(by) == focal, F.col(c))).over(w).alias(f"f_{c}") for c in SCALARS]
    both = means.join(alike, by).select("*", *own_means)
    clamped, free = style_similarity({c: F.col(c) for c in SCALARS}, {c: F.col(f"f_{c}") for c in SCALARS}, F.col("words_alike"))
    return both.select(by, clamped.alias("similarity"), free.alias("unclamped"))


def style_drift(profile: DataFrame, terms: DataFrame, by: str, order: list[str]) -> DataFrame:
    """Each text against the one before it in its group.

    ``order`` is two columns: a coarse one (the year) and a numeric one that tells equals apart (the id).
    (id, by, previous, term_change, new_terms, lost_terms, change of each scalar): ``terms`` has
    (id, terms array). The change of terms is the Jaccard distance, null if both sets are empty.
    """
    rows = profile.where("n_words > 0").join(terms, "id", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<string>")))
    # A group's order is cut into ranges: the text before is in the same range, or the last of the range before, of which there is one row each.
    own = F.struct("id", "terms", *SCALARS)
    rows = rows.withColumn("_a", F.col(order[0])).withColumn("_b", F.floor(F.col(order[1]) / RANGE))
    within = Window.partitionBy(by, "_a", "_b").orderBy(*order)
    lasts = rows.groupBy(by, "_a", "_b").agg(F.max_by(own, F.struct(*order)).alias("last"))
    lasts = lasts.withColumn("edge", F.lag("last").over(Window.partitionBy(by).orderBy("_a", "_b"))).drop("last")
    rows = rows.withColumn("before", F.lag(own).over(within))
    first = rows.where("before is null").drop("before")
    same = first[by].eqNullSafe(lasts[by]) & first["_a"].eqNullSafe(lasts["_a"]) & first["_b"].eqNullSafe(lasts["_b"])
    first = first.join(lasts, same).drop(lasts[by]).drop(lasts["_a"]).drop(lasts["_b"]).withColumnRenamed("edge", "before")
    rows = rows.where("before is not null").unionByName(first.where("before is not null"))
    both, either = F.size(F.array_intersect("terms", F.col("before.terms"))), F.size(F.array_union("terms", F.col("before.terms")))
    return rows.select(
        "id", by, F.col("before.id").alias("previous"), (1 - F.try_divide(both.cast("double"), either)).alias("term_change"),
        F.size(F.array_except("terms", F.col("before.terms"))).alias("new_terms"), F.size(F.array_except(F.col("before.terms"), "terms")).alias("lost_terms"),
        *[F.try_divide(F.abs(F.col(c) - F.col(f"before.{c}")), F.nullif(F.col(f"before.{c}"), F.lit(0.0))).alias(f"d_{c}") for c in SCALARS],
    )


def drift_events(drift: DataFrame, by: str, order: list[str], term_limit: float = 0.3, scalar_limit: float = 0.1) -> DataFrame:
    """(id, by, kind, change): beyond the limits, from the second transition of a group on."""
    later = drift.withColumn("at", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("at > 1")
    kinds = [F.struct(F.lit("terms").alias("kind"), F.col("term_change").alias("change"), F.lit(term_limit).alias("least"))]
    kinds += [F.struct(F.lit(c).alias("kind"), F.col(f"d_{c}").alias("change"), F.lit(scalar_limit).alias("least")) for c in SCALARS]
    return later.select("id", by, F.explode(F.array(*kinds)).alias("k")).where("k.change > k.least").select("id", by, "k.kind", "k.change")
