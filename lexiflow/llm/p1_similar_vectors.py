"""The k most similar vectors of every vector, by additive quantisation.

A vector is approximated by the sum of one word from each of several full-dimensional codebooks.
The codebooks are trained on a bounded sample: k-means on the residuals of the levels before, then
a joint least-squares update of all codebooks for the sample's codes. Every row is encoded by beam
search over the residuals and keeps the norm of its approximation. The first two codes together are
the row's inverted list. The two books have as many words each as give lists of ``LIST_ROWS`` rows on
average, so the number of lists grows with the rows and the work of a query, a fixed number of lists of constant
length, does not. The rows of a list are scored by lookup tables, one table of dot products for
each query and codebook, and the best of each list are reranked by the exact cosine.

Exact copies form one class that is searched once. Lists are cut into chunks and their queries into
blocks of bounded size, so a crowded direction becomes many tasks and none of them large.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import bounded_sample, checkpointed, col, spread

SAMPLE_ROWS, LEVELS, WORDS, BEAM, CHUNK = 20_000, 6, 256, 4, 2048
#: Mean rows of a list, lists that a query visits, first words whose lists are compared.
LIST_ROWS, PROBES, FIRST_WORDS = 256, 12, 16


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.concatenate([((centres**2).sum(1) - 2 * (b @ centres.T)).argmin(1) for b in np.array_split(x, max(1, len(x) // 4096))])
        counts = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.choice(len(x), k)]).astype(np.float32)
    return centres


@dataclass
class AdditiveQuantizer:
    books: list[np.ndarray]
    beam: int = BEAM

    @classmethod
    def fit(cls, sample: np.ndarray, lists: int, levels: int = LEVELS, words: int = WORDS, beam: int = BEAM, seed: int = 11) -> AdditiveQuantizer:
        rng = np.random.default_rng(seed)
        q = cls([_kmeans(sample, lists, rng)], beam)
        for level in range(levels):
            q.books.append(_kmeans(sample - q.decode(q.encode(sample)), lists if level == 0 else words, rng))
        codes, offsets = q.encode(sample), np.cumsum([0, *(len(b) for b in q.books)])
        places, n = codes + offsets[:-1], offsets[-1]
        gram, right = np.zeros(n * n), np.zeros((n, sample.shape[1]))
        for i in range(len(q.books)):
            np.add.at(right, places[:, i], sample)
            for j in range(len(q.books)):
                gram += np.bincount(places[:, i] * n + places[:, j], minlength=n * n)
        old = np.concatenate(q.books)
        ridge = 1.0
        gram = gram.reshape(n, n) + ridge * np.eye(n)
        joint = np.linalg.solve(gram, right + ridge * old).astype(np.float32)
        q.books = [joint[a:b] for a, b in zip(offsets[:-1], offsets[1:])]
        return q

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes, shape (rows, books), of the best sum that a beam search finds."""
        return np.concatenate([self._encode(b) for b in np.array_split(x, max(1, len(x) // 2048))]) if len(x) else np.zeros((0, len(self.books)), np.int64)

    def _encode(self, x: np.ndarray) -> np.ndarray:
        n, dim = x.shape
        codes, rest = np.zeros((n, 1, 0), np.int64), x[:, None, :]
        for book in self.books:
            width, size = rest.shape[1], len(book)
            cross = rest.reshape(-1, dim) @ book.T
            error = ((rest**2).sum(-1)[:, :, None] + (book**2).sum(1) - 2 * cross.reshape(n, width, size)).reshape(n, -1)
            best = min(self.beam, error.shape[1])
            keep = np.argpartition(error, best - 1, axis=1)[:, :best] if best < error.shape[1] else np.broadcast_to(np.arange(best), (n, best))
            keep = np.take_along_axis(keep, np.take_along_axis(error, keep, 1).argsort(1, kind="stable"), 1)
            beam, word = np.divmod(keep, size)
            codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), word[:, :, None]], 2)
            rest = np.take_along_axis(rest, beam[:, :, None], 1) - book[word]
        return codes[:, 0]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(book[codes[:, i]] for i, book in enumerate(self.books))

    def lists_of(self, codes: np.ndarray) -> np.ndarray:
        return codes[:, 0] * len(self.books[1]) + codes[:, 1]

    def probes(self, x: np.ndarray, n: int | None) -> np.ndarray:
        """The ``n`` nearest lists of each row, shape (rows, n), or all lists."""
        first, second = self.books[0], self.books[1]
        total = len(first) * len(second)
        if n is None or n >= total:
            return np.broadcast_to(np.arange(total), (len(x), total))
        t = min(len(first), max(FIRST_WORDS, -(-n // len(second))))
        out = []
        norms = (first**2).sum(1)[:, None] + (second**2).sum(1) + 2 * (first @ second.T)
        for part in np.array_split(x, max(1, len(x) // 512)):
            one, two = part @ first.T, part @ second.T
            # The first words by the best list they can give.
            near = np.argpartition((first**2).sum(1) - 2 * one, t - 1, axis=1)[:, :t]
            far = norms[near] - 2 * np.take_along_axis(one, near, 1)[:, :, None] - 2 * two[:, None, :]
            best = np.argpartition(far.reshape(len(part), -1), n - 1, axis=1)[:, :n]
            word, other = np.divmod(best, len(second))
            out.append(np.take_along_axis(near, word, 1) * len(second) + other)
        return np.concatenate(out)

    def score(self, x: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Approximate cosines, shape (queries, rows), from lookup tables."""
        out = (x @ self.books[0].T)[:, codes[:, 0]]
        for i, book in enumerate(self.books[1:], 1):
            out += np.take(x @ book.T, codes[:, i], axis=1)
        return out / norms


def _unit(column: pd.Series, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows are vectors, their unit vectors): cut or filled with zeros to ``width``."""
    out, ok = np.zeros((len(column), width)), np.zeros(len(column), bool)
    for i, v in enumerate(column):
        if v is not None:
            v = np.asarray(v, np.float64)[:width]
            out[i, : len(v)] = v
            ok[i] = np.isfinite(v).all() and v.any()
    out = out[ok]
    return ok, (out / np.linalg.norm(out, axis=1, keepdims=True)).astype(np.float32)


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, vector binary): float32 unit vectors; null, zero and non-finite vectors and null ids are left out."""
    base = spread(df.select(col(id_col).cast("long").alias("id"), col(vector_col).alias("v"))).where("id is not null and v is not null")

    def prepare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ok, x = _unit(b["v"], width)
            yield pd.DataFrame({"id": b["id"][ok], "vector": [r.tobytes() for r in x]})

    return base.mapInPandas(prepare, "id long, vector binary")


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float32).reshape(-1, width)


def most_similar(
    df: DataFrame, id_col: str, vector_col: str, *, k: int = 5, width: int = 64, min_cosine: float = -1.0, queries: DataFrame | None = None, probes: int | None = PROBES, rerank: int = 96, list_rows: int = LIST_ROWS, sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """(id, other, cosine, rank): of each vector the ``k`` most similar others with a cosine of at least ``min_cosine``.

    Vectors are filled with zeros or cut to ``width``. Null, all-zero and non-finite vectors and null
    ids take no part. Equal cosines rank by the lesser ``other``; repeated rows of an id count once
    (its least vector). ``queries`` (one column of ids) limits the rows that are looked up, against all rows.
    ``probes`` lists of ``list_rows`` rows on average are visited by each; None visits all lists.
    ``rerank`` of each list chunk are compared exactly. ``sample_rows`` bounds the rows on which the
    codebooks are trained. Empty tables give an empty result.
    """
    spark = df.sparkSession
    # A vector's class is named by 128 bits of its hash, so copies of one vector are never one task's work.
    named = [F.xxhash64("vector").alias("h1"), F.xxhash64("vector", F.lit(1)).alias("h2")]
    vectors = checkpointed(unit_vectors(df, id_col, vector_col, width).groupBy("id").agg(F.min("vector").alias("vector")).select("id", "vector", *named))
    classes = vectors.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.min("vector").alias("vector"))
    n = vectors.select("h1", "h2").distinct().count()
    rows = bounded_sample(classes.select("vector"), sample_rows, n, "vector")
    if not rows:
        return spark.createDataFrame([], "id long, other long, cosine double, rank int")
    sample = np.frombuffer(b"".join(bytes(r["vector"]) for r in rows), np.float32).reshape(-1, width)
    lists = max(1, min(round(math.sqrt(n / list_rows)), len(sample) // 4))
    shared = spark.sparkContext.broadcast(AdditiveQuantizer.fit(sample, lists, words=min(WORDS, max(1, len(sample) // 4))))
    del rows, sample

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        q = shared.value
        for b in batches:
            if len(b):
                x = _matrix(b["vector"], width)
                codes = q.encode(x)
                norms = np.maximum(np.linalg.norm(q.decode(codes), axis=1), 1e-6).astype(np.float32)
                yield pd.DataFrame({"first": b["first"], "vector": b["vector"], "list": q.lists_of(codes).astype(np.int32), "codes": [r.tobytes() for r in codes.astype(np.uint16)], "norm": norms, "visits": list(q.probes(x, probes).astype(np.int32))})

    # Used four times from here on, so written once to the shared folder.
    encoded = checkpointed(classes.select("first", "vector").mapInPandas(encode, "first long, vector binary, list int, codes binary, norm float, visits array<int>"))
    members = vectors.select("id", "h1", "h2").join(classes.select("h1", "h2", "first"), ["h1", "h2"]).select("id", "first")
    wanted = queries.select(F.col(queries.columns[0]).cast("long").alias("id")).distinct() if queries is not None else None
    asked = encoded.join(members.join(wanted, "id", "left_semi").select("first").distinct(), "first", "left_semi") if wanted is not None else encoded
    visits = asked.select("first", "vector", F.explode("visits").alias("list"))
    # Chunks and blocks per list: one narrow row each, joined, not collected.
    sizes = encoded.groupBy("list").agg(F.count("*").alias("n")).join(visits.groupBy("list").agg(F.count("*").alias("asks")), "list")
    parts = sizes.select("list", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks"), F.ceil(F.col("asks") / CHUNK).cast("int").alias("blocks"))
    chunk, block = F.pmod(F.xxhash64("first"), F.col("chunks")).cast("int"), F.pmod(F.xxhash64("first"), F.col("blocks")).cast("int")
    stored = encoded.join(parts, "list").select("list", chunk.alias("chunk"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(False).alias("asks"), "first", "vector", "codes", "norm")
    asking = visits.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), block.alias("block"), F.lit(True).alias("asks"), "first", "vector", F.lit(None).cast("binary").alias("codes"), F.lit(None).cast("float").alias("norm"))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        q, mine = shared.value, group["asks"].to_numpy()
        queries_, rows_ = group[mine], group[~mine]
        if not len(queries_) or not len(rows_):
            return pd.DataFrame({"first": [], "other": [], "cosine": []})
        x, y = _matrix(queries_["vector"], width), _matrix(rows_["vector"], width)
        codes = np.frombuffer(b"".join(rows_["codes"]), np.uint16).reshape(len(rows_), -1).astype(np.int64)
        norms, ids, asker = rows_["norm"].to_numpy(), rows_["first"].to_numpy(), queries_["first"].to_numpy()
        out = []
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            depth = min(len(y), max(rerank, k + 1))
            if depth < len(y):
                approx = q.score(part, codes, norms)
                near = np.argpartition(-approx, depth - 1, axis=1)[:, :depth]
            else:
                near = np.broadcast_to(np.arange(len(y)), (len(part), len(y)))
            exact = np.einsum("qd,qrd->qr", part, y[near], dtype=np.float64, casting="unsafe") if depth < len(y) else (part.astype(np.float64) @ y.T.astype(np.float64))
            order = np.lexsort((ids[near], -exact), axis=1)[:, : k + 1]
            exact, near = np.take_along_axis(exact, order, 1), np.take_along_axis(near, order, 1)
            who, which = np.nonzero(exact >= min_cosine - 1e-9)
            out.append(pd.DataFrame({"first": asker[at + who], "other": ids[near[who, which]], "cosine": exact[who, which]}))
        return pd.concat(out)

    found = stored.unionByName(asking).groupBy("list", "chunk", "block").applyInPandas(search, "first long, other long, cosine double")
    by_class = found.groupBy("first").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("cosine")).alias("far"), "other"))), 1, k + 1).alias("near"))
    # Members of a class: its k + 1 least ids are all that can rank among the k most similar; the limit applies before the shuffle.
    least = members.select(F.col("first").alias("other"), "id", F.row_number().over(_by("first").orderBy("id")).alias("at")).where(F.col("at") <= k + 1).groupBy("other").agg(F.collect_list("id").alias("ids"))
    near = by_class.select("first", F.explode("near").alias("x")).select("first", "x.far", "x.other").join(least, "other").select("first", "far", F.explode("ids").alias("other"))
    best = near.groupBy("first").agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "other"))), 1, k + 1).alias("near"))
    who = members if wanted is None else members.join(wanted, "id", "left_semi")
    own = who.join(best, "first").select("id", F.slice(F.filter("near", lambda n: n["other"] != F.col("id")), 1, k).alias("near"))
    return own.select("id", F.posexplode("near").alias("at", "n")).select("id", F.col("n.other").alias("other"), (-F.col("n.far")).alias("cosine"), (F.col("at") + 1).alias("rank"))


def _by(column: str):
    from pyspark.sql import Window

    return Window.partitionBy(column)
