"""p1, p2: against brute force, with nulls, ties, copies, empty tables and clashing names."""

import random

import numpy as np
from pyspark.sql import functions as F

from lexiflow.llm import p1_similar_vectors as p1
from lexiflow.llm import p2_near_duplicates as p2
from lexiflow.llm import queries
from lexiflow.llm.common import words

VEC = "ID long, embedding array<float>, id2 string, vector string, first string"


def crowd(n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 6, dim))
    x = centres[rng.integers(0, len(centres), n)] + 0.15 * rng.normal(size=(n, dim))
    x[: n // 3] = centres[0] + 0.05 * rng.normal(size=(n // 3, dim))  # a third in one direction
    x[5] = x[6] = x[7]
    return x.astype(np.float32)


def table(spark, x, extra=()):
    rows = [(i, [float(v) for v in r], "x", "y", "z") for i, r in enumerate(x)] + list(extra)
    return spark.createDataFrame(rows, VEC)


def brute(x, k):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    return np.argsort(-s, axis=1, kind="stable")[:, :k], s


def test_neighbours_recall_and_exact_scores(spark):
    x = crowd()
    got = p1.most_similar(table(spark, x), "ID", "embedding", k=5, width=16, list_rows=16).collect()
    want, s = brute(x, 5)
    near = {}
    for r in got:
        near.setdefault(r.id, {})[r.rank] = r
    assert len(near) == len(x) and all(len(v) == 5 for v in near.values())
    assert all(abs(r.cosine - s[r.id, r.other]) < 1e-5 and r.id != r.other for r in got)
    hits = sum(len({r.other for r in near[i].values()} & set(want[i])) for i in range(len(x)))
    assert hits / (5 * len(x)) >= 0.97
    # Three equal vectors: the other two come first, the lesser id before the greater.
    assert [near[5][k].other for k in (1, 2)] == [6, 7] and [near[7][k].other for k in (1, 2)] == [5, 6]


def test_neighbours_edge_cases(spark):
    bad = [(90, None, "", "", ""), (91, [0.0] * 4, "", "", ""), (92, [float("nan"), 1.0, 0.0, 0.0], "", "", ""), (None, [1.0, 0.0, 0.0, 0.0], "", "", ""), (1, [1.0, 0.0, 0.0, 0.0], "", "", "")]
    df = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0], "", "", ""), (2, [1.0, 0.1, 0.0, 0.0, 5.0], "", "", ""), (3, [0.0, 0.0, 1.0], "", "", ""), *bad], VEC)
    got = p1.most_similar(df, "ID", "embedding", k=5, width=4, min_cosine=0.9).collect()
    assert {(r.id, r.other, r.rank) for r in got} == {(1, 2, 1), (2, 1, 1)}
    assert p1.most_similar(df.where("false"), "ID", "embedding", width=4).collect() == []
    only = p1.most_similar(df, "ID", "embedding", k=1, width=4, queries=df.where("ID = 2").select("ID")).collect()
    assert [(r.id, r.other) for r in only] == [(2, 1)]


def test_quantizer_error_falls_with_levels():
    x = crowd()
    errors = []
    for levels in (0, 2, 4):
        q = p1.AdditiveQuantizer.fit(x, 20, levels=levels, words=32)
        errors.append(((x - q.decode(q.encode(x))) ** 2).sum())
    assert errors[0] > errors[1] > errors[2]
    codes = q.encode(x[:50])
    norms = np.linalg.norm(q.decode(codes), axis=1)
    assert np.allclose(q.score(x[:3], codes, norms), x[:3] @ q.decode(codes).T / norms, atol=1e-4)


def texts(seed=1, n=240):
    rnd = random.Random(seed)
    vocabulary = [f"сл{i}ово" for i in range(900)]
    out = []
    for i in range(n):
        if i and rnd.random() < 0.5:
            w = list(out[rnd.randrange(len(out))])
            for _ in range(rnd.choice((0, 3, 10, 25))):
                w[rnd.randrange(len(w))] = rnd.choice(vocabulary)
            rnd.shuffle(w)
        else:
            w = rnd.sample(vocabulary, rnd.randint(50, 120))
        out.append(w)
    return [" ".join(w) for w in out]


def test_pairs_against_brute_force(spark):
    t = texts()
    df = spark.createDataFrame([(f"k{i:03}", x, "id", "text") for i, x in enumerate(t)], "key string, body string, id string, text string")
    got = {tuple(r) for r in p2.near_duplicate_pairs(df, "key", "body", similarity=0.6, min_words=60).collect()}
    sets = [set(words(x)) for x in t]
    want = {(f"k{i:03}", f"k{j:03}") for i in range(len(t)) for j in range(i + 1, len(t)) if min(len(sets[i]), len(sets[j])) >= 60 and len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert len(want) > 100 and got <= want and len(got) >= 0.99 * len(want)


def test_pair_forms_and_edge_cases(spark):
    base = " ".join(f"w{i}" for i in range(20))
    rows = [("a", base, 1), ("b", base.upper() + "!", 1), ("c", base + " extra", 1), ("a", "wholly other words here", 2), ("d", None, 1), ("e", "", 1), (None, base, 1), ("f", "w1 w2", 1)]
    df = spark.createDataFrame(rows, "id string, content string, at int")
    how = {"order_col": "at", "similarity": 0.9, "min_words": 5}
    assert {tuple(r) for r in p2.near_duplicate_pairs(df, "id", "content", **how).collect()} == {("a", "b"), ("a", "c"), ("b", "c")}
    got = {r.id: (r.copies, r.links) for r in p2.near_duplicate_links(df, "id", "content", **how).collect()}
    assert got == {"a": (2, 1), "b": (2, 1), "c": (1, 2)}
    assert p2.near_duplicate_pairs(df.where("false"), "id", "content", **how).collect() == []


def test_hot_group_of_copies(spark):
    base = " ".join(f"w{i}" for i in range(30))
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, F.lit(base)).otherwise(F.concat(F.lit(base), F.lit(" x"), (F.col("id") % 7).cast("string"))).alias("content"))
    got = p2.near_duplicate_links(df, "id", "content", similarity=0.8)
    assert got.count() == 3000 and got.where("copies + links <> 3000").count() == 0


def test_every_item_has_a_class(spark, tmp_path):
    bulletin = " ".join(f"w{i}" for i in range(40))
    rows = [(f"b{i}", bulletin if i % 2 else bulletin + " x", i) for i in range(20)] + [(f"o{i}", " ".join(f"v{i}n{j}" for j in range(20 + i)), i) for i in range(36)]
    rows += [("null", None, 0), ("none", "", 0), ("marks", "— !", 0), ("one", "слово", 0), ("b1", "later", 9), (None, bulletin, 0)]
    spark.createDataFrame(rows, "id string, content string, created_at int").write.parquet(f"{tmp_path}/news.parquet")
    rows_ = queries.p2_news_classes(spark, str(tmp_path)).collect()
    got = {r.id: (r.copies, r.links) for r in rows_}
    assert len(rows_) == len(got) == 60
    assert all(v == ((10, 10) if i[0] == "b" else (1, 0)) for i, v in got.items())
    assert len({r["class"] for r in rows_}) == 2 + 36 + 4
