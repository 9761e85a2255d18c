import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lexiflow.operators import chunking, evolution, network, occurrences, ontology, profile, retrieval, stylometry, sweep, terms


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_key_terms_order_and_ties(spark):
    tf = terms.top_terms(docs(spark, "яма дом яма яма-куст куст", None, ""), "doc_id", "text", 9)
    assert [(r.term, r.tf) for r in tf.collect()] == [("яма", 3), ("куст", 2), ("дом", 1)]
    tf = terms.top_terms(docs(spark, "яма яма яма куст куст дом", None, ""), "doc_id", "text", 2)
    top = terms.key_terms(tf, 1).collect()
    assert [(r.term, r.rank) for r in top] == [("куст", 1)]  # of the two most frequent the first by name
    weights = spark.createDataFrame([("яма", 2.0)], "term string, weight double")
    assert terms.key_terms(tf, 1, weights).first().term == "яма"


def test_profiles(spark):
    rows = {r.id: r for r in stylometry.profiles(docs(spark, "Раз два. Три, четыре!\n\nПять", "", None), "doc_id", "text").collect()}
    assert rows[0].n_words == 5 and rows[0].n_sentences == 3 and math.isclose(rows[0].sentence_length, 5 / 3)
    assert rows[0].comma == 1 and math.isclose(rows[0].paragraph_length, 2.0)
    assert rows[1].n_words is None and rows[2].n_words is None


def test_style_similarity_saturates(spark):
    part = {c: F.lit(1.0) for c in stylometry.SCALARS}
    far = part | {"paragraph_length": F.lit(100.0)}
    same, gone = spark.range(1).select(stylometry.style_similarity(part, part, F.lit(1.0))[0].alias("a"), stylometry.style_similarity(part, far, F.lit(1.0))[0].alias("b")).first()
    assert math.isclose(same, 1.0) and gone == 0.0


def test_carried_concepts(spark):
    rows = ontology.sentence_concepts(docs(spark, "Начало. Растёт труд. Ещё дело. Рынок рыночный."), "doc_id", "text").orderBy("pos").collect()
    assert [(r.pos, r.concept, r.own) for r in rows] == [(1, "труд", True), (2, "труд", False), (3, "рынок", True)]


def test_first_relation(spark):
    rel = spark.createDataFrame([("a", "b", 0.5), ("b", "c", 0.9), ("a", "c", 0.5)], "source string, target string, strength double")
    got = {r.concept: (r.source, r.target) for r in ontology.first_relation(rel, spark.createDataFrame([("a",), ("b",), ("x",)], "concept string")).collect()}
    assert got == {"a": ("a", "b"), "b": ("b", "c")}


def test_occurrences_do_not_overlap(spark):
    rows = occurrences.find_occurrences(docs(spark, "аааа Б", None, "нет"), "doc_id", "text", ["аа", "б", ""], 1).orderBy("term", "start").collect()
    assert [(r.term, r.start, r.end, r.context) for r in rows] == [("аа", 0, 2, "ааа"), ("аа", 2, 4, "ааа "), ("б", 5, 6, " Б")]


def test_shift_of_zero_vector(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("a", [0.0, 1.0]), ("z", [1.0, 0.0])], "concept string, vector array<double>")
    o = spark.createDataFrame([("a", [1.0, 0.0]), ("z", [0.0, 0.0])], "concept string, vector array<double>")
    assert {r.concept: r.transformation_index for r in occurrences.shift_index(v, o, 1).collect()} == {"a": 0.5, "z": 1.0}


def test_cooccurrence(spark):
    t = spark.createDataFrame([(1, "a", 1900), (1, "b", 1900), (2, "b", 1910), (2, "a", 1910), (3, "a", 1905)], "id long, term string, year int")
    r = network.cooccurrence(t).collect()
    assert len(r) == 1 and (r[0].t1, r[0].t2, r[0]["count"]) == ("a", "b", 2) and math.isclose(r[0].weight, 2.2)
    assert network.normalised(network.cooccurrence(t)).first().share == 1.0


def test_evolution(spark):
    v = spark.createDataFrame([(1, 0.1), (2, 0.2), (4, 0.21)], "volume_id int, x double")
    assert [r.volume_id for r in evolution.turning_points(v, "x").collect()] == [2]
    y = spark.createDataFrame([(1905,), (1880,)], "year int")
    assert {r.period for r in evolution.in_periods(y, "year").collect()} == {"Ранний период", "Революционный период"}


def test_sections_and_windows(spark):
    s = chunking.split_sections(docs(spark, "a\n\n\n\nb\fc"), "doc_id", "text").collect()
    assert [r.section for r in s] == ["a", "b", "c"]
    w = chunking.token_windows(docs(spark, "a b c d e", "", None), "doc_id", "text", 2, 2).collect()
    assert [r.text for r in w] == ["a b", "c d"]


def test_notes(spark):
    text = chunking.restore_notes(docs(spark, "Из Гегеля: Гегель\n\n\nКОРОТКАЯ ТЕМА\nодна\nдва\nNB важно"), "doc_id", "text", ["Гегель"], ["NB"]).first().text
    assert text == "\n\n[ИСТОЧНИК: Гегель]\n\n\n\n\n[ТЕМА: КОРОТКАЯ ТЕМА]\n\nодна два \n[КОММЕНТАРИЙ]: NB важно\n"


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="аб. \n", max_size=400))
def test_recursive_pieces_hold_the_text(text):
    pieces = chunking.recursive_pieces(text, 40, 10)
    assert all(p.strip() for p in pieces)
    assert set("".join(text.split())) == set("".join("".join(pieces).split()))
    if all(len(line) < 30 for line in text.split("\n")):
        assert all(len(p) <= 40 for p in pieces)


def test_neighbours_and_pairs(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [1.0])], "id long, v array<double>")
    unit = retrieval.unit_rows(rows.select("id", F.col("v").cast("array<float>").alias("v")), "id", "v", 2)
    near = retrieval.top_k(unit.where("id = 1"), unit, 2).orderBy("rank").collect()
    assert [r.other for r in near] == [6, 2]
    assert {(r.a, r.b) for r in retrieval.related_within(unit.withColumn("group", F.lit("g")), 0.9, block=2).collect()} == {(1, 2), (1, 6), (2, 6)}


def test_sweep(spark):
    assert sweep.grid(spark).count() == 378
    runs = spark.createDataFrame([("m", 1, 0, 10, 2.0, 1.0, 5.0, None), ("m", 2, 5, 30, 2.0, 1.0, 6.0, None), ("m", 3, 5, 30, 0.0, 1.0, 1.0, "e")], "model string, run_id long, gpu_layers int, tokens int, gen_time double, load_time double, max_vram double, error string")
    r = sweep.summary(runs, ["model"]).first()
    assert (r.runs, r.passed, r.fastest_run, r.leanest_run) == (3, 2, 2, 1)
    assert sweep.speed_up(runs, "model").first().ratio == 3.0


def test_json_profile(spark):
    rows = spark.createDataFrame([('{"a": 1, "b": "x"}',), ('{"a": [1]}',), ("no json",), (None,)], "j string")
    assert {(r.key, r.kind) for r in profile.json_profile(rows, "j").collect()} == {("a", "integer"), ("a", "array"), ("b", "string")}


def test_relation_factor_and_neighbours(spark):
    t = spark.createDataFrame([(1, "a", 1900), (1, "b", 1900), (2, "b", 1910), (2, "a", 1910), (3, "a", 1900), (3, "c", 1900)], "id long, term string, year int")
    rel = spark.createDataFrame([("a", "x", "y"), ("b", "x", "z"), ("q", "x", "y")], "concept string, source string, target string")
    got = {(r.t1, r.t2): round(r.weight, 6) for r in network.cooccurrence(t, relations=rel).collect()}
    assert got == {("a", "b"): round(2 * 1.1 * 1.2, 6), ("a", "c"): 1.0}
    edges = spark.createDataFrame([("n", "a"), ("n", "b"), ("m", "c")], "t1 string, t2 string")
    assert {r.term for r in network.neighbours(edges, spark.createDataFrame([("n",), ("c",)], "term string")).collect()} == {"a", "b", "m"}


def test_key_terms_with_links(spark):
    most = spark.createDataFrame([(1, "a", 5), (1, "b", 4), (1, "c", 3)], "id long, term string, tf long")
    weights, linked = spark.createDataFrame([("a", 0.5), ("b", 0.9)], "term string, weight double"), spark.createDataFrame([("b",)], "term string")
    assert [(r.term, round(r.score, 6)) for r in terms.key_terms(most, 2, weights, linked).orderBy("rank").collect()] == [("b", 1.17), ("c", 1.0)]


def test_block_joins_against_brute_force(spark):
    import numpy as np

    x = np.random.default_rng(1).normal(size=(60, 8))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, [float(c) for c in v], "g" if i % 3 else "h") for i, v in enumerate(u)], "id long, v array<double>, group string")
    cos = u @ u.T
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if cos[i, j] > 0.3 and (i % 3 == 0) == (j % 3 == 0)}
    for block in (7, 1000):
        assert {(r.a, r.b) for r in retrieval.related_within(rows, 0.3, block=block).collect()} == want
        got = {(r.id, r["rank"]): r.other for r in retrieval.top_k(rows.where("id < 9"), rows, 3, block=block).collect()}
        assert got == {(i, k + 1): [j for j in np.argsort(-cos[i]) if j != i][k] for i in range(9) for k in range(3)}


def test_drift_over_ranges_equals_one_window(spark, monkeypatch):
    rows = [(i, "s" if i % 4 else None, 1900 + i % 3, "Раз два три. " * (1 + i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, year int, text string")
    prof = stylometry.profiles(df, "doc_id", "text", "source", "year")
    lists = df.select(F.col("doc_id").alias("id"), F.array(F.concat(F.lit("t"), F.col("doc_id") % 7)).alias("terms"))
    found = []
    for size in (3, 100_000):
        monkeypatch.setattr(stylometry, "RANGE", size)
        found.append({tuple(r) for r in stylometry.style_drift(prof, lists, "source", ["year", "id"]).collect()})
    assert found[0] == found[1] and len(found[0]) == 38


def test_marks_names_and_stand_ins(spark):
    from lexiflow.functions import text as T
    from lexiflow.functions import vectors as V

    t = F.lit("Уважаемый Петров! 3 мая 1901 г. Понятие «труд» и тезис 1 (см. главу). Вчера приехал Иван Сомов, а с ним Анна.")
    r = spark.range(1).select(T.letter_markup(t).alias("letter"), T.semantic_clean(F.lit("Эмпирио критицизм, том II, Стр. 5 и Материализм")).alias("scan"), T.structure_marks(t).alias("marks"), T.entities(t).alias("names"), V.hashed_bag(F.split(F.lit("а б а"), " "), 8).alias("bag")).first()
    assert "[ОБРАЩЕНИЕ: Уважаемый Петров!]" in r.letter and "[ДАТА: 3 мая 1901 г.]" in r.letter
    assert r.scan == "эмпириокритицизм, ,  и материализм"
    assert {m["kind"] for m in r.marks} == {"thesis", "concept", "reference"} and r.names == ["Петров", "Иван Сомов", "Анна"]
    assert sum(r.bag) == 3 and len(r.bag) == 8
    df = spark.createDataFrame([("ok",), (None,), ("bad",)], "n string")
    assert [r.c for r in df.where("n = 'ok' or n is null").select(T.code_of(F.col("n"), {"OK": 5}).alias("c")).collect()] == [5, None]
    with pytest.raises(Exception, match="unknown name"):
        df.select(T.code_of(F.col("n"), {"OK": 5})).collect()


def test_bag_reads_its_words_once(spark):
    from lexiflow.functions import text as T
    from lexiflow.functions import vectors as V

    # Words that are other ones whenever they are read again: only one reading gives as many counts as words.
    drawn = F.array(*[F.rand(i).cast("string") for i in range(50)])
    assert {sum(r.bag) for r in spark.range(40).select(V.hashed_bag(drawn).alias("bag")).collect()} == {50.0}
    known = spark.createDataFrame([(["а", "б", "а", None],), ([],)], "words array<string>")
    place = {w: spark.range(1).select(F.pmod(F.xxhash64(F.lit(w).cast("string")), F.lit(4))).first()[0] for w in ("а", "б", None)}
    want = [[float(sum(place[w] == i for w in words)) for i in range(4)] for words in (["а", "б", "а", None], [])]
    assert [r.bag for r in known.select(V.hashed_bag(F.col("words"), 4).alias("bag")).collect()] == want
    marks = spark.range(1).select(T.alphabet_clean(F.lit("Ёж, 𝒳 и\u2028 ёлка\n№ 5 — А-Я\x00 i\u00a0ї")).alias("c")).first().c
    assert marks == "ёж и ёлка а-я"


def test_few_terms_have_no_components(spark):
    assert all(r.components is None for r in terms.tfidf_svd(docs(spark, "яма куст", None), "doc_id", "text", 50).collect())
    rows = terms.tfidf_svd(docs(spark, "яма яма куст", "дом куст стена", "стена яма", ""), "doc_id", "text", 2).collect()
    assert len(rows) == 4 and all(len(r.components) == 2 for r in rows)


def test_components_are_those_of_the_whole_matrix(spark):
    import numpy as np

    texts = ["яма яма куст дом", "дом куст стена", "стена яма", "", "куст пень дом дом", None, "лес яма пень", "поле река лес"]
    got = {r.id: r.components for r in terms.tfidf_svd(docs(spark, *texts).repartition(3), "doc_id", "text", 3, 6).withColumnRenamed("doc_id", "id").collect()}
    # Of equally frequent terms the first by name: of лес, пень and стена, twice each, all, of поле and река none.
    words = ["дом", "яма", "куст", "лес", "пень", "стена"]
    counts = np.array([[(t or "").split().count(w) for w in words] for t in texts], dtype=float)
    tfidf = counts * np.log((len(texts) + 1) / ((counts > 0).sum(axis=0) + 1))
    axes = np.linalg.svd(tfidf)[2][:3].T
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), range(3)])
    assert np.allclose([got[i] for i in sorted(got)], tfidf @ axes)


def test_samples_repeat(spark):
    rows = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(90)], "id long, g string")
    one, two = ({tuple(r) for r in occurrences.sample_per(rows, "g", "id", 5, seed=4).collect()} for _ in "ab")
    assert one == two and len(one) == 10
