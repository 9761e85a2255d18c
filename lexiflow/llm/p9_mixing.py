"""Mixing sources to target weights by weighted fair queueing.

Every source is shuffled by a seeded hash, pass after pass. A document's virtual finish time is the
cumulative tokens of its source up to and with it, over all passes so far, divided by the source's
target weight. Served in the order of finish times, all sources hold their weights at every moment;
the mixture is cut where the budget is used up. A source that has used up its passes leaves the
queue and the others share what it leaves, in proportion to their weights.

Token positions within a source come from two levels of sums (hash buckets of bounded size, then
rows of a bucket), so no source is ever one task. Only one row per source is collected.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, col, spread

TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Fixed value: the pre-tokenisation pattern that belongs to the public vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BUCKET_ROWS, SEED = 20_000, 17


def with_tokens(df: DataFrame, id_col: str, text_col: str, source_col: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(id, source, tokens): token counts of whole texts by a public byte-level vocabulary; a null text has 0."""
    base = spread(df.select(col(id_col).alias("id"), col(source_col).cast("string").alias("source"), col(text_col).alias("text")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        with open(tokenizer, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encoding = tiktoken.Encoding("mix", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        for b in batches:
            yield pd.DataFrame({"id": b["id"], "source": b["source"], "tokens": [len(encoding.encode_ordinary(t)) if isinstance(t, str) else 0 for t in b["text"]]})

    return base.mapInPandas(count, f"id {base.schema['id'].dataType.simpleString()}, source string, tokens long")


def service_time(caps: dict[str, tuple[float, float | None]], budget: float | None) -> float:
    """The virtual time at which the budget is used up; ``caps``: source -> (weight, most tokens or None).

    Without a budget: the last time at which every source still holds its weight.
    """
    ends = sorted(most / w for w, most in caps.values() if most is not None and w > 0)
    if budget is None:
        return ends[0] if ends else 0.0
    now = spent = 0.0
    for end in [*ends, float("inf")]:
        rate = sum(w for w, most in caps.values() if w > 0 and (most is None or most / w >= end))
        if rate <= 0:
            break
        if spent + rate * (end - now) >= budget:
            return now + (budget - spent) / rate
        spent, now = spent + rate * (end - now), end
    return now


def mixture(df: DataFrame, targets: DataFrame, id_col: str, text_col: str, source_col: str, *, budget: int | None = None, of_corpus: float | None = None, tokenizer: str = TOKENIZER, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """The mixture (id, source, pass, tokens, finish) in serving order, and the report of its shares.

    ``targets`` has source, target_share and max_repeats: the most passes over the source (null: no
    cap). ``budget`` is in tokens; ``of_corpus`` gives it as a part of the listed sources' tokens;
    with neither it is the largest budget at which every listed source that has documents holds its
    share, so the shares come as near to the targets as documents of whole length allow. Where no source has a cap
    that is one pass over all listed tokens.

    The report has, per listed source: source, target_share, reachable_share (the target among the
    sources that have tokens), documents, tokens, share, passes (begun). Documents of null or
    unlisted sources, null ids and documents without tokens are never drawn. Equal hashes are
    ordered by id; repeated rows are documents of their own. A listed source without documents is
    reported with share 0, as are sources with a null or zero target. Empty tables give empty results.
    """
    listed = targets.select(F.col("source").cast("string").alias("source"), F.coalesce(F.col("target_share").cast("double"), F.lit(0.0)).alias("target_share"), F.col("max_repeats").cast("int").alias("max_repeats")).where("source is not null").dropDuplicates(["source"])
    # The tokens are counted once and read three times.
    counted = checkpointed(with_tokens(df, id_col, text_col, source_col, tokenizer).where("id is not null and source is not null and tokens > 0"))
    totals = {r["source"]: r for r in listed.join(counted.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")), "source", "left").collect()}
    caps = {s: (r["target_share"], None if r["max_repeats"] is None else r["max_repeats"] * r["t"]) for s, r in totals.items() if r["t"] and r["target_share"] > 0}
    all_tokens = sum(r["t"] for r in totals.values() if r["t"])
    if budget is None and (of_corpus is not None or all(most is None for _, most in caps.values())):
        budget = round((of_corpus if of_corpus is not None else 1.0) * all_tokens)
    until = service_time(caps, budget)
    plan = [(s, w, float(totals[s]["t"]), int(-(-w * until // totals[s]["t"])) if most is None else min(totals[s]["max_repeats"], int(-(-w * until // totals[s]["t"]))), max(1, -(-totals[s]["n"] // BUCKET_ROWS))) for s, (w, most) in caps.items()]
    spark = df.sparkSession
    passes = spark.createDataFrame([p for p in plan if p[3] > 0], "source string, weight double, total double, passes int, buckets int")
    drawn = counted.join(F.broadcast(passes), "source").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("passes"))))  # one row per listed source
    drawn = drawn.withColumn("h", F.xxhash64(F.lit(seed), "pass", F.col("id").cast("string"))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 8), F.col("buckets")))
    sums = drawn.groupBy("source", "pass", "bucket").agg(F.sum("tokens").alias("s"))
    before = sums.withColumn("before", F.coalesce(F.sum("s").over(Window.partitionBy("source", "pass").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("s")
    inner = F.sum("tokens").over(Window.partitionBy("source", "pass", "bucket").orderBy("h", F.col("id").cast("string")).rowsBetween(Window.unboundedPreceding, 0))
    placed = drawn.withColumn("within", inner).join(before, ["source", "pass", "bucket"]).withColumn("finish", ((F.col("pass") - 1) * F.col("total") + F.col("before") + F.col("within")) / F.col("weight"))
    chosen = placed.where(F.col("finish") <= until * (1 + 1e-12)).select("id", "source", "pass", "tokens", "finish")
    used = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"), F.max("pass").alias("passes"))
    reach = sum(w for w, _ in caps.values()) or 1.0
    report = listed.join(used, "source", "left").join(F.broadcast(spark.createDataFrame([(s, w / reach) for s, (w, _) in caps.items()], "source string, reachable_share double")), "source", "left")
    whole = F.sum("tokens").over(Window.partitionBy(F.lit(0)))  # over one row per listed source
    report = report.withColumn("whole", whole).select("source", "target_share", F.coalesce("reachable_share", F.lit(0.0)).alias("reachable_share"), F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(F.col("tokens") / F.col("whole"), F.lit(0.0)).alias("share"), F.coalesce("passes", F.lit(0)).alias("passes"))
    return chosen.orderBy("finish", "source", "pass", "id"), report
