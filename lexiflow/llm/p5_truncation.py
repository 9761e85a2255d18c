"""Texts that were cut off: right-censored length distributions combined with ending evidence.

A field limit censors lengths from the right: many values have exactly the limit's length. For each
source a log-normal length distribution is fitted by maximum likelihood (EM, with the values at
a candidate limit treated as censored), and each value gets the posterior of being censored: the
part of the values at its length that the fitted density does not explain. Limits in words may be
given with the row (``limit_col``); limits in characters are found as spikes of the source's lengths.

The ending of the text is the other evidence, in two parts that are independent of the limits: the mark it
ends with (a stop, dots, a structured line such as a signature, hashtags, list item or link, an abbreviation,
nothing at all) and its last word (whether the corpus knows it as a word that sentences or lines end on, as
one from inside sentences, as a rare one, or not at all). A latent class model joins the three: EM
estimates, from the counts of (limit, mark, word) over all texts, how often each mark and word comes with cut
and with whole texts and which part of the texts at a limit, of each level of the censoring posterior, is
cut. The prior tables are worth ``PRIOR_TEXTS`` texts and only tell which class is which. A
text that finishes its last sentence is no case even at a limit, so ``finished`` is whole by
definition, as is ``signed``, a full signature line.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, col, spread

#: Signs for nothing: a text that is one of them, or has no word, is no text that could be cut.
NOTHING = "null none nil nan na n a n/a нет ничего пусто undefined empty void".split()
#: Abbreviations and initials after which something must follow.
UNFINISHED = r"(?iu)(?:(?<![\p{L}\p{N}])(?:стр|см|им|тов|рис|табл|ср|напр|т\. ?е|vgl|cf|fig|vol|bzw|mr|mrs|dr)|(?<![\p{L}\p{N}])\p{Lu})\.$"

#: Prior shares of marks and last words among cut and whole texts; the data's own replace them.
MARKS = {"finished": (0.0, 0.94), "signed": (0.0, 0.01), "open": (0.9, 0.001), "abbreviation": (0.05, 0.001), "dots": (0.04, 0.02), "structured": (0.01, 0.028)}
LAST_WORDS = {"ends": (0.2, 0.96), "inside": (0.25, 0.015), "rare": (0.1, 0.015), "short": (0.1, 0.005), "unknown": (0.35, 0.005)}
PRIOR_TEXTS, BASE_SHARE = 100.0, 0.05
#: Levels of the censoring posterior (upper ends); level 0 is off all limits.
LEVELS = (0.0, 0.5, 0.8, 0.95, 1.0)
MIN_SPIKE = 5


def stripped(text: Column) -> Column:
    """Without trailing white space, whole tags and entities."""
    return F.regexp_replace(text, r"(?:\s|\x{00A0}|</?[A-Za-z][^<>]{0,40}>|&(?:[A-Za-z]{2,8}|#\d{1,6});)+$", "")


def has_words(text: Column) -> Column:
    """Whether a text has a word beside markup and is not just a sign for nothing."""
    bare = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"</?[A-Za-z][^<>]{0,40}>|&(?:[A-Za-z]{2,8}|#\d{1,6});", " ")), r"[^\p{L}\p{N}/]+", " "))
    return F.coalesce((F.regexp_replace(bare, "/", "") != "") & ~bare.isin(NOTHING), F.lit(False))


def ending(text: Column) -> Column:
    """The class of a stripped text's ending, before the corpus is asked about the last word."""
    last = F.trim(F.element_at(F.split(text, "\n"), -1))
    dots = text.rlike(r"(?:\.\.+|…)[»”\"')\]]*$")
    stop = text.rlike(r"[.!?][»”\"'’)\]]*$") & ~text.rlike(UNFINISHED)
    lined = F.instr(text, "\n") > 0
    structured = (
        (lined & last.rlike(r"^(?:[•·*–—-]|\d{1,3}[.)])\s+\S.*[\p{L}\p{N}»)]$"))
        | last.rlike(r"^(?:#[\p{L}\p{N}_]+[\s,]*)+$")
        | last.rlike(r"(?:^|\s)(?:https?://|www\.)[^\s/]+\.[^\s/]+/\S*$")
        | (lined & last.rlike(r"^[—–-]\s*\p{Lu}[\p{L} -]+$"))
    )
    signed = lined & (last.rlike(r"^[—–-]\s*\p{Lu}[\p{L}-]+(?: \p{Lu}\.){2}$") | last.rlike(r"^\([^()]*\)$"))
    return F.when(signed, "signed").when(dots, "dots").when(stop, "finished").when(structured, "structured").when(text.rlike(UNFINISHED), "abbreviation").otherwise("open")


def _tokens(text: Column) -> Column:
    """array<struct<word, ends>> of a text's words but the last; ends: a sentence or line ends after it."""
    marks = F.regexp_extract_all(F.lower(F.translate(text, "ёЁ", "еЕ")), F.lit(r"[\p{L}\p{N}]+(?:[.!?…]+[»”\"')\]]*(?=\s)|(?=\n))?"), F.lit(0))
    inner = F.slice(marks, F.lit(1), F.greatest(F.size(marks) - 1, F.lit(0)))
    return F.transform(inner, lambda m: F.struct(F.regexp_extract(m, r"^[\p{L}\p{N}]+", 0).alias("word"), (m.rlike(r"[.!?…]") | m.rlike(r"\n")).alias("ends")))


def _fit(values: pd.DataFrame, measure: str) -> list[tuple]:
    """(length, posterior) of the candidate limits of one source's lengths (columns length, n, declared)."""
    v = values.groupby("length", as_index=False).agg(n=("n", "sum"), declared=("declared", "max")).sort_values("length")
    length, n = v["length"].to_numpy(float), v["n"].to_numpy(float)
    total = n.sum()
    x = np.log(np.maximum(length, 1))
    mu, sigma = float(np.average(x, weights=n)), max(0.05, float(np.sqrt(np.average((x - np.average(x, weights=n)) ** 2, weights=n))))
    if measure == "words":
        candidate = v["declared"].to_numpy(bool)
    else:
        # Mean count of the 24 lengths around, by running sums over the sorted lengths.
        sums = np.concatenate([[0.0], np.cumsum(n)])
        near = (sums[np.searchsorted(length, length + 12, "right")] - sums[np.searchsorted(length, length - 12, "left")] - n) / 24
        candidate = (n >= MIN_SPIKE) & (n >= 4 * np.maximum(near, 0.25)) & (length >= 20)
    # EM: the part of the values at a candidate limit that the density leaves over is censored; their full lengths lie beyond.
    censored = np.where(candidate, n, 0.0)
    for _ in range(25):
        density = np.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * np.sqrt(2 * np.pi)) / np.maximum(length, 1)
        censored = np.where(candidate, np.maximum(0.0, n - total * density), 0.0)
        z = (x - mu) / sigma
        tail = np.maximum(1e-9, 0.5 * _erfc(z / np.sqrt(2)))
        hazard = np.exp(-0.5 * z**2) / np.sqrt(2 * np.pi) / tail
        mean = mu + sigma * hazard
        second = mu**2 + sigma**2 + sigma * (x + mu) * hazard
        seen = n - censored
        mu = float((seen * x + censored * mean).sum() / total)
        sigma = float(np.sqrt(max(0.0025, (seen * x**2 + censored * second).sum() / total - mu**2)))
    return [(L, c / k, c) for L, c, k in zip(length, censored, n) if c > 0]


def _erfc(z: np.ndarray) -> np.ndarray:
    from math import erfc

    return np.array([erfc(a) for a in z])


def censoring_limits(lengths: DataFrame) -> DataFrame:
    """(source, measure, limit, posterior, censored) from (source, measure, slot, length, n, declared).

    One fit per source, measure and slot (the declared limit, for words); each reads the counts of
    distinct lengths only.
    """

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        first = group.iloc[0]
        rows = [(first["source"], first["measure"], first["slot"], int(L), float(min(0.999, p)), float(c)) for L, p, c in _fit(group, first["measure"])]
        return pd.DataFrame(rows, columns=["source", "measure", "slot", "limit", "posterior", "censored"])

    return lengths.groupBy("source", "measure", "slot").applyInPandas(fit, "source string, measure string, slot int, limit int, posterior double, censored double")


def cut_posteriors(counts: pd.DataFrame, rounds: int = 200) -> pd.DataFrame:
    """``counts`` (level, mark, word, at, n) with the posterior of being cut, by EM over the latent class model.

    At most levels x marks x words rows come in, however many the texts; ``at`` is the mean censoring
    posterior of the level.
    """
    c = counts.reset_index(drop=True)
    n = c["n"].to_numpy(float)
    tables = [(c["mark"].map({k: i for i, k in enumerate(MARKS)}).to_numpy(), np.array(list(MARKS.values()))), (c["word"].map({k: i for i, k in enumerate(LAST_WORDS)}).to_numpy(), np.array(list(LAST_WORDS.values())))]
    level = c["level"].to_numpy(int)
    start = np.full(len(LEVELS), BASE_SHARE)
    for k in range(1, len(LEVELS)):
        if (level == k).any():
            start[k] = np.average(c["at"].to_numpy(float)[level == k], weights=n[level == k])
    share, shares = start.copy(), [prior.copy() for _, prior in tables]
    posterior = np.zeros(len(c))
    for _ in range(rounds):
        cut, whole = share[level], 1 - share[level]
        for (index, _), table in zip(tables, shares):
            cut, whole = cut * table[index, 0], whole * table[index, 1]
        posterior = cut / np.maximum(cut + whole, 1e-300)
        for k in range(len(LEVELS)):
            at = level == k
            share[k] = np.clip((start[k] * PRIOR_TEXTS + (n * posterior)[at].sum()) / (PRIOR_TEXTS + n[at].sum()), 1e-4, 0.999)
        for which, (index, prior) in enumerate(tables):
            for side, weight in ((0, n * posterior), (1, n * (1 - posterior))):
                sums = np.bincount(index, weight, len(prior)) + PRIOR_TEXTS * prior[:, side]
                shares[which][:, side] = sums / sums.sum()
    return c.assign(posterior=posterior)


def truncation(df: DataFrame, id_col: str, text_col: str, source_col: str, *, limit_col: str | None = None, vocabulary_from: list[tuple[DataFrame, str]] | None = None) -> DataFrame:
    """(id, source, text_key, text_length, mark, last_word, at_limit, posterior, truncated): one row per distinct (id, text, source).

    ``text_key`` is ``xxhash64`` of the text, ``at_limit`` the censoring posterior of its length alone,
    ``posterior`` that of all evidence; from 0.5 on the text counts as truncated.

    ``source_col`` groups the length distributions (null is a group of its own); ``limit_col`` gives
    a declared limit in words. Texts of ``vocabulary_from`` add to the corpus that knows whole words.
    Null ids, null texts and texts without a word are never truncated (posterior 0, mark
    ``nothing``); repeated rows come out once. An empty table gives an empty result.
    """
    limit = col(limit_col).cast("int") if limit_col else F.lit(None).cast("int")
    base = spread(df.select(col(id_col).alias("id"), col(text_col).alias("text"), col(source_col).cast("string").alias("source"), limit.alias("slot")))
    bare = base.select("id", "source", "slot", F.xxhash64("text").alias("text_key"), has_words(F.col("text")).alias("some"), F.length("text").alias("chars"), F.size(F.filter(F.split(F.trim("text"), r"\s+"), lambda w: w != "")).alias("words"), stripped(F.col("text")).alias("bare"))
    # What stands at the end is read from the reversed text, however long it is.
    back = F.reverse(F.translate(F.col("bare"), "ёЁ", "еЕ"))
    classed = bare.select(
        "id", "source", "slot", "text_key", "some", "chars", "words", F.when(F.col("some"), ending(F.col("bare"))).otherwise("nothing").alias("mark"),
        F.lower(F.reverse(F.regexp_extract(back, r"^[^\p{L}\p{N}]*+([\p{L}\p{N}]++)", 1))).alias("last"),
        back.rlike(r"^[\s,]*+[\p{L}\p{N}_]++#").alias("tagged"), back.rlike(r"^\S+?(?://:s?ptth|\.www)").alias("link"),
    )
    # Without the texts: written once, read for the lengths, the words to ask about and the judgement.
    rows = checkpointed(classed.distinct())

    some = rows.where("some")
    chars = some.groupBy("source", F.col("chars").alias("length")).agg(F.count("*").alias("n")).select("source", F.lit("chars").alias("measure"), F.lit(0).alias("slot"), "length", "n", F.lit(False).alias("declared"))
    declared = some.where("slot is not null").groupBy("source", "slot", F.col("words").alias("length")).agg(F.count("*").alias("n")).select("source", F.lit("words").alias("measure"), "slot", "length", "n", (F.col("length") == F.col("slot")).alias("declared"))
    limits = checkpointed(censoring_limits(chars.unionAll(declared)))
    by_chars = limits.where("measure = 'chars'").select(F.col("source").alias("s1"), F.col("limit").alias("l1"), F.col("posterior").alias("p1"))
    by_words = limits.where("measure = 'words'").select(F.col("source").alias("s2"), F.col("slot").alias("k2"), F.col("limit").alias("l2"), F.col("posterior").alias("p2"))

    corpus = base.select(F.col("text").alias("t")).where("t is not null")
    for other, name in vocabulary_from or []:
        corpus = corpus.unionAll(other.select(col(name).alias("t")).where("t is not null"))
    asked = some.select(F.col("last").alias("word")).distinct()
    counted = corpus.select(F.explode(_tokens(F.col("t"))).alias("k")).select("k.word", "k.ends").groupBy("word").agg(F.count("*").alias("known"), F.count_if("ends").alias("known_ends"))
    # The last words of finished texts end sentences too; each text's own is taken off again below.
    closing = some.where("mark = 'finished'").groupBy(F.col("last").alias("word")).agg(F.count("*").alias("known"), F.count("*").alias("known_ends"))
    counted = counted.join(asked, "word", "left_semi").unionAll(closing).groupBy(F.col("word").alias("last")).agg(F.sum("known").alias("known"), F.sum("known_ends").alias("known_ends"))
    known = checkpointed(counted)

    # The three small tables are written, so their sizes are known when the joins are planned.
    joined = rows.join(known, "last", "left").join(by_chars, F.col("source").eqNullSafe(F.col("s1")) & (F.col("chars") == F.col("l1")), "left").join(by_words, F.col("source").eqNullSafe(F.col("s2")) & (F.col("slot") == F.col("k2")) & (F.col("words") == F.col("l2")), "left")
    own = F.when(F.col("mark") == "finished", 1).otherwise(0)
    n, e = F.coalesce("known", F.lit(0)) - own, F.coalesce("known_ends", F.lit(0)) - own
    # A full link or tag ends a line whatever the corpus knows of it; a tag is a word the corpus has elsewhere.
    word = (
        F.when((F.col("mark") == "signed") | ((F.col("mark") == "structured") & F.col("link")), "ends")
        .when((F.col("mark") == "structured") & F.col("tagged"), F.when(n >= 2, "ends").when(n == 1, "rare").otherwise("unknown"))
        .when(n == 0, "unknown").when(F.length("last") <= 2, "short").when(e >= F.greatest(F.lit(1), n * 0.01), "ends").when(n < 5, "rare").otherwise("inside")
    )
    at = F.greatest(F.coalesce("p1", F.lit(0.0)), F.coalesce("p2", F.lit(0.0)))
    judged = joined.withColumn("last_word", word).withColumn("at_limit", at)
    level = F.lit(len(LEVELS) - 1)
    for k in reversed(range(len(LEVELS) - 1)):
        level = F.when(F.col("at_limit") <= LEVELS[k], k).otherwise(level)
    judged = judged.withColumn("level", level)
    # At most 5 x 5 x 5 rows.
    counts = judged.where("some").groupBy("level", "mark", "last_word").agg(F.avg("at_limit").alias("at"), F.count("*").alias("n")).withColumnRenamed("last_word", "word").toPandas()
    fitted = {f"{r.level} {r.mark} {r.word}": float(r.posterior) for r in cut_posteriors(counts).itertuples()} if len(counts) else {}
    table = F.create_map(*[F.lit(x) for kv in fitted.items() for x in kv]) if fitted else F.create_map().cast("map<string,double>")
    posterior = F.coalesce(F.when(F.col("some"), F.try_element_at(table, F.concat_ws(" ", "level", "mark", "last_word"))), F.lit(0.0))
    return judged.select("id", "source", "text_key", F.col("chars").alias("text_length"), "mark", "last_word", "at_limit", posterior.alias("posterior"), (posterior > 0.5).alias("truncated"))


def truncation_report(judged: DataFrame, by: str = "source") -> DataFrame:
    """(source, texts, truncated, share): how often each source truncates."""
    return judged.groupBy(by).agg(F.count("*").alias("texts"), F.count_if("truncated").alias("truncated")).withColumn("share", F.round(F.col("truncated") / F.col("texts"), 6))
