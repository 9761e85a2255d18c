"""Near-duplicate texts by pigeonhole blocks over fingerprints.

Every text becomes the set of its distinct words. ``bands * rows`` min-wise values of the set form
its fingerprint, which is split into ``bands`` blocks of ``rows`` values each. If two fingerprints
differ in fewer than ``bands`` places, by the pigeonhole principle one block is equal in both; in
general two sets of Jaccard similarity s share a block with probability
``1 - (1 - s**rows) ** bands`` (0.9987 at s = 0.6, 0.99999 at 0.7 with the defaults). Pairs that share
a block are verified by the Hamming distance of a 184-bit sketch (one bit per min-wise value), whose
threshold lies 3.5 standard deviations beyond the distance expected at the wanted similarity, and
then exactly on the two sets.

Both steps use the one fingerprint: the sketch is its values reduced to a bit each. The pigeonhole bound
as such holds for pairs that differ in fewer than ``bands`` places; for the others, down to the wanted
similarity, the probability above takes its place.

Texts with the same word set are one class, so copies cost nothing beyond the first; blocks join
on 64-bit keys with only the sketch beside them. No block is capped: a block shared by very many
classes is split by adaptive skew handling of the sort-merge join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import col, spread, words_of

BANDS, ROWS, SKETCH_BITS = 48, 4, 184
PARTITION_BYTES, MOST_PARTITIONS = 16_000_000, 20_000


def hamming_limit(similarity: float, bits: int = SKETCH_BITS, sigmas: float = 3.5) -> int:
    """Bits by which two sketches may differ: equal bits are expected in (1 + s) / 2 of the places."""
    p = (1 - similarity) / 2
    return math.ceil(bits * p + sigmas * math.sqrt(bits * p * (1 - p)))


def _coefficients(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def minwise(flat: np.ndarray, starts: np.ndarray, n: int, seed: int = 7) -> np.ndarray:
    """Min-wise values, shape (n, sets): ``flat`` has the hashed members of all sets one after another."""
    mult, add = _coefficients(n, seed)
    flat = flat.view(np.uint64)
    flat = flat ^ (flat >> np.uint64(29))
    out = np.empty((n, len(starts)), np.uint32)
    for i in range(n):
        out[i] = np.minimum.reduceat(((flat * mult[i] + add[i]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def word_sets(df: DataFrame, id_col: str, text_col: str, order_col: str | None, min_words: int) -> DataFrame:
    """(id, set_key, words): of each id the first row by ``order_col``; only sets of ``min_words`` or more."""
    base = spread(df.select(col(id_col).alias("id"), col(text_col).alias("text"), (col(order_col) if order_col else F.lit(0)).alias("at"))).where("id is not null")
    hashed = base.select("id", "at", F.array_sort(F.array_distinct(F.transform(words_of("text"), lambda w: F.xxhash64(w)))).alias("words"))
    return hashed.withColumn("words", F.when(F.size("words") >= min_words, F.col("words"))).withColumn("set_key", F.xxhash64("words", F.lit(1)))


def near_duplicate_classes(df: DataFrame, id_col: str, text_col: str, *, order_col: str | None = None, similarity: float = 0.8, min_words: int = 1, every: bool = False, bands: int = BANDS, rows: int = ROWS) -> tuple[DataFrame, DataFrame]:
    """Membership (id, class) and links (class_a, class_b, similarity), class_a < class_b.

    A class is a set of words; its id is a 64-bit hash of the sorted set. Links are between
    different classes whose sets have a Jaccard similarity of at least ``similarity``.

    Null ids are left out. Null, empty and short texts (fewer than ``min_words`` distinct words)
    belong to no class; with ``every`` each such id is a class of its own without links. If an id
    comes more than once, its row first by ``order_col`` counts, then the one with the least set key
    (any row if all are equal). An empty table gives two empty results. Other columns of ``df`` are
    never read.
    """
    sets = word_sets(df, id_col, text_col, order_col, min_words)
    members = sets.groupBy("id").agg(F.min(F.struct("at", F.isnull("words").alias("none"), "set_key")).alias("m"))
    own = F.when(F.col("m.none"), F.xxhash64("id", F.lit(2))).otherwise(F.col("m.set_key")) if every else F.col("m.set_key")
    members = (members if every else members.where("not m.none")).select("id", own.alias("class"))
    classes = sets.where("words is not null").groupBy("set_key").agg(F.first("words").alias("words"))

    n = bands * rows

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            lengths = b["words"].map(len).to_numpy()
            flat = np.concatenate(b["words"].to_numpy()).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            values = minwise(flat, starts, max(n, SKETCH_BITS))
            # Three words: 184 bits of the sketch, and in the last byte the set's size on a log scale.
            bits = np.zeros((192, len(b)), np.uint64)
            bits[:SKETCH_BITS] = values[:SKETCH_BITS] & 1
            weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
            sketch = [(bits[k * 64 : k * 64 + 64] * weights[:, None]).sum(0, dtype=np.uint64) for k in range(3)]
            sketch[2] |= np.minimum(255, np.round(16 * np.log2(lengths))).astype(np.uint64) << np.uint64(56)
            keys = np.zeros((bands, len(b)), np.uint64)
            for band in range(bands):
                h = np.full(len(b), (band + 1) * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
                for r in range(rows):
                    h = (h ^ values[band * rows + r]) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(31)
                keys[band] = h
            yield pd.DataFrame({"set_key": b["set_key"], **{f"s{k}": x.view(np.int64) for k, x in enumerate(sketch)}, "blocks": list(keys.T.view(np.int64))})

    prints = classes.mapInPandas(blocks, "set_key long, s0 long, s1 long, s2 long, blocks array<long>")
    # Partitions follow the exploded rows (at most one class a row of the table), of some 48 bytes each.
    rows_out = df.count() * bands
    partitions = max(1, math.ceil(rows_out * 48 / max(PARTITION_BYTES, rows_out * 48 / MOST_PARTITIONS)))
    side = prints.select("set_key", "s0", "s1", "s2", F.explode("blocks").alias("block")).repartition(partitions, "block")
    a, b = (side.select("block", *[F.col(c).alias(f"{c}_{s}") for c in ("set_key", "s0", "s1", "s2")]) for s in "ab")
    apart = [F.col(f"s{k}_a").bitwiseXOR(F.col(f"s{k}_b")) for k in range(3)]
    distance = F.bit_count(apart[0]) + F.bit_count(apart[1]) + F.bit_count(F.shiftleft(apart[2], 8))
    sizes = [F.shiftrightunsigned(f"s2_{s}", 56) for s in "ab"]
    sizes_fit = F.abs(sizes[0] - sizes[1]) <= math.ceil(16 * math.log2(1 / similarity)) + 1
    near = a.join(b, "block").where((F.col("set_key_a") < F.col("set_key_b")) & sizes_fit & (distance <= hamming_limit(similarity)))
    pairs = near.select("set_key_a", "set_key_b").distinct()
    left = classes.select(F.col("set_key").alias("set_key_a"), F.col("words").alias("words_a"))
    right = classes.select(F.col("set_key").alias("set_key_b"), F.col("words").alias("words_b"))
    both = pairs.join(left, "set_key_a").join(right, "set_key_b").withColumn("common", F.size(F.array_intersect("words_a", "words_b")))
    exact = both.select(F.col("set_key_a").alias("class_a"), F.col("set_key_b").alias("class_b"), (F.col("common") / (F.size("words_a") + F.size("words_b") - F.col("common"))).alias("similarity"))
    return members, exact.where(F.col("similarity") >= similarity)


def near_duplicate_links(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """One row per id that has a class, with ``every`` per id: (id, class, copies, links).

    ``copies`` counts the ids of the class, ``links`` the ids of other classes linked to it.
    """
    members, links = near_duplicate_classes(df, id_col, text_col, **how)
    sizes = members.groupBy("class").agg(F.count("*").alias("copies"))
    ends = links.select(F.col("class_a").alias("class"), F.col("class_b").alias("other")).unionAll(links.select(F.col("class_b").alias("class"), F.col("class_a").alias("other")))
    linked = ends.join(sizes.select(F.col("class").alias("other"), F.col("copies").alias("more")), "other").groupBy("class").agg(F.sum("more").alias("links"))
    return members.join(sizes, "class").join(linked, "class", "left").select("id", "class", "copies", F.coalesce("links", F.lit(0)).alias("links"))


def near_duplicate_pairs(df: DataFrame, id_col: str, text_col: str, **how) -> DataFrame:
    """(id_a, id_b), id_a < id_b: every pair of ids whose classes are the same or linked."""
    members, links = near_duplicate_classes(df, id_col, text_col, **how)
    copies = members.groupBy("class").agg(F.count("*").alias("n")).where("n > 1").select("class")
    same = copies.select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    linked = same.unionAll(links.select("class_a", "class_b"))
    a = members.select(F.col("id").alias("x"), F.col("class").alias("class_a"))
    b = members.select(F.col("id").alias("y"), F.col("class").alias("class_b"))
    pairs = linked.join(a, "class_a").join(b, "class_b").where("class_a <> class_b or x < y")
    return pairs.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
