"""The queries over the driver's tables and their SQL twins, side by side.

Author is ``source``, the focal author is ``FOCAL``. Every query reads its whole tables.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiflow.functions import lexicon
from lexiflow.functions import text as T
from lexiflow.functions import vectors as V
from lexiflow.operators import chunking, dialogs, evolution, network, occurrences, ontology, profile, retrieval, store, stylometry, sweep, terms
from lexiflow.plans import sql as S
from lexiflow.session import ensure_checkpoint_dir
from lexiflow.sources import readers, sinks

FOCAL = "fond_polozov"
NEEDLES = ["труд", "капитал", "ошибк"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def big(column) -> F.Column:
    return column.cast("bigint")


# --- text -----------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({S.clean('text')}) AS clean_md5, len({S.tokens('text')}) AS n_tokens, len(list_distinct({S.tokens('text')})) AS n_distinct FROM documents WHERE text IS NOT NULL")
def clean_tokens(spark, d):
    rows = read(spark, d, "documents").where("text is not null").select("doc_id", T.alphabet_clean(F.col("text")).alias("c"), T.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.md5("c").alias("clean_md5"), big(F.size("t")).alias("n_tokens"), big(F.size(F.array_distinct("t"))).alias("n_distinct"))


_TYPE = "CASE " + " ".join(f"WHEN contains(lower(filename), '{a}') THEN '{b}'" for a, b in lexicon.DOCUMENT_TYPES) + f" ELSE '{lexicon.DEFAULT_TYPE}' END"


@query(rf"SELECT doc_id, {_TYPE} AS file_type, coalesce(try_cast(nullif(regexp_extract(filename, '\d{{4}}'), '') AS INTEGER), 1900)::BIGINT AS file_year, coalesce(try_cast(nullif(regexp_extract(filename, '(?i)том[\s_]*(\d{{1,9}})', 1), '') AS INTEGER), 0)::BIGINT AS file_volume FROM documents")
def file_rules(spark, d):
    f = F.col("filename")
    return read(spark, d, "documents").select("doc_id", T.document_type(f).alias("file_type"), big(T.year_of(f, 1900)).alias("file_year"), big(T.volume_of(f)).alias("file_volume"))


_HEAD = "lower(array_to_string(list_slice(string_split(section_text, chr(10)), 1, 3), ' '))"
_REASONS = ["CASE WHEN length(section_text) < 2000 THEN 'length<2000' END", *[f"CASE WHEN contains({_HEAD}, '{k}') THEN 'keyword:{k}' END" for k in lexicon.SECTION_KEYWORDS]]
_REASONS += [rf"CASE WHEN regexp_matches({_HEAD}, 'стр[а-я]*\.?\s*\d+') THEN 'page_number' END", r"CASE WHEN len(string_split(section_text, chr(10))) > 3 AND regexp_matches(list_extract(string_split(section_text, chr(10)), -1), '\d{1,2}\s*[а-я]+\s*\d{4}') THEN 'signature/date' END"]
_REASONS_SQL = f"list_filter([{', '.join(_REASONS)}], lambda r: r IS NOT NULL)"


@query(f"SELECT section_id, array_to_string({_REASONS_SQL}, ';') AS reasons, len({_REASONS_SQL}) = 0 AS kept FROM sections WHERE section_text IS NOT NULL")
def section_exclusion(spark, d):
    rows = read(spark, d, "sections").where("section_text is not null").select("section_id", T.exclusion_reasons(F.col("section_text")).alias("r"))
    return rows.select("section_id", F.array_join("r", ";").alias("reasons"), (F.size("r") == 0).alias("kept"))


@query(f"WITH r AS (SELECT section_id, unnest({_REASONS_SQL}) AS reason FROM sections WHERE section_text IS NOT NULL) SELECT reason, count(*) AS times, count(DISTINCT section_id) AS sections FROM r GROUP BY reason")
def exclusion_stats(spark, d):
    rows = read(spark, d, "sections").where("section_text is not null").select("section_id", F.explode(T.exclusion_reasons(F.col("section_text"))).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("times"), F.count_distinct("section_id").alias("sections"))


@query(r"WITH p AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, unnest(range(0, len(p))) AS part, unnest(p) AS s FROM p) SELECT doc_id, part, md5(regexp_replace(s, '^\s+|\s+$', '', 'g')) AS md5 FROM r WHERE regexp_matches(s, '\S')")
def section_split(spark, d):
    rows = chunking.split_sections(read(spark, d, "documents"), "doc_id", "text", "\n\n")
    return rows.select(F.col("id").alias("doc_id"), big(F.col("part")).alias("part"), F.md5("section").alias("md5"))


_REFS_GONE = r"regexp_replace(regexp_replace(text, '\[\s*(?:\d+|стр\.\s*\d+)\s*\]', '', 'g'), '-\s*\n\s*', '', 'g')"


@query(f"SELECT doc_id, md5({S.squeeze(_REFS_GONE)}) AS clean_md5 FROM documents WHERE text IS NOT NULL")
def corpus_clean(spark, d):
    return read(spark, d, "documents").where("text is not null").select("doc_id", F.md5(T.chunk_clean(F.col("text"))).alias("clean_md5"))


@query()
def dataset_clean(spark, d):
    return read(spark, d, "documents").select("doc_id", T.dataset_clean(F.col("text")).alias("clean"))


@query(rf"SELECT DISTINCT id, md5(coalesce({S.squeeze(r"regexp_replace(regexp_replace(content, '<[^>]+>', '', 'g'), '[^\p{L}\p{N}_\s.,!?;:-]', '', 'g')")}, '')) AS clean_md5 FROM news")
def html_strip(spark, d):
    return read(spark, d, "news").select("id", F.md5(T.html_strip(F.col("content"))).alias("clean_md5")).distinct()


_ANSWER = "analysis"
for _s in lexicon.BOILERPLATE_STARTS:
    _ANSWER = f"regexp_replace({_ANSWER}, '(?i){_s}[^.!?]*[.!?]', '', 'g')"


@query(rf"""WITH a AS (SELECT DISTINCT news_id, analysis FROM analysis WHERE analysis IS NOT NULL), c AS (SELECT news_id, {_ANSWER} AS t FROM a),
p AS (SELECT news_id, regexp_extract_all(t, '[^.!?]*[.!?]') AS e, regexp_extract(t, '[^.!?]*$') AS r FROM c),
s AS (SELECT news_id, CASE WHEN len(e) >= 2 THEN list_slice(e, 1, 2) WHEN r <> '' THEN list_append(e, r) ELSE e END AS k FROM p)
SELECT news_id, md5(array_to_string(list_transform(k, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), ' ')) AS clean_md5 FROM s""")
def answer_clean(spark, d):
    return read(spark, d, "analysis").where("analysis is not null").select("news_id", "analysis").distinct().select("news_id", F.md5(T.answer_clean(F.col("analysis"))).alias("clean_md5"))


@query()
def answer_forms(spark, d):
    """The two other cleaners of answers."""
    t = F.col("response")
    return read(spark, d, "parameter_results").where("response is not null").select("run_id", T.first_sentences(t, failed="—").alias("two_sentences"), T.cut_at_last_stop(t).alias("to_last_stop")).distinct()


@query()
def markup(spark, d):
    """Tags of letters and critiques, after scanner corrections."""
    t = T.semantic_clean(F.col("text"))
    return read(spark, d, "documents").where("text is not null").select("doc_id", T.critique_markup(T.letter_markup(t)).alias("text"))


@query()
def notes_restored(spark, d):
    rows = chunking.restore_notes(read(spark, d, "documents").where("document_type = 'notebook'"), "doc_id", "text", ["Зотречых", "Древлянян"])
    return rows.withColumnRenamed("id", "doc_id")


def _esc(c: str) -> str:
    return rf"trim(replace(replace(replace(regexp_replace({c}, '[\x00-\x1F\x7F-\x{{9F}}]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))"


def _msg(body: str) -> str:
    return f"'<b>' || {_esc('title')} || '</b>' || chr(10) || chr(10) || {body} || chr(10) || chr(10) || '<a href=''' || url || '''>→</a>'"


@query(f"SELECT DISTINCT id, md5(CASE WHEN length({_msg(_esc('content'))}) > 600 THEN {_msg(f"left({_esc('content')}, 300) || '...'")} ELSE {_msg(_esc('content'))} END) AS message_md5 FROM news WHERE title IS NOT NULL AND content IS NOT NULL")
def messages(spark, d):
    rows = read(spark, d, "news").where("title is not null and content is not null")
    return rows.select("id", F.md5(T.compose_message(F.col("title"), F.col("content"), F.col("url"), 600, 300)).alias("message_md5")).distinct()


_PHRASES = " OR ".join(f"contains(lower(analysis), '{p}')" for p in lexicon.TEMPLATE_PHRASES)


@query(f"SELECT DISTINCT news_id, coalesce(length(analysis) >= 30 AND NOT ({_PHRASES}) AND contains(analysis, '.'), false) AS good FROM analysis")
def quality_gate(spark, d):
    return read(spark, d, "analysis").select("news_id", T.quality_answer(F.col("analysis")).alias("good")).distinct()


@query("SELECT source, count(*) AS items, count_if(id = md5(url)) AS keyed, count_if(NOT regexp_matches(content, '[\\x{0400}-\\x{04FF}]')) AS other_script FROM news WHERE content IS NOT NULL GROUP BY source")
def url_ids(spark, d):
    rows = read(spark, d, "news").where("content is not null")
    return rows.groupBy("source").agg(F.count("*").alias("items"), F.count_if(F.col("id") == F.md5("url")).alias("keyed"), F.count_if(~T.has_script(F.col("content"))).alias("other_script"))


# --- terms and style ------------------------------------------------------------------------------


def _concept_words(spark, d) -> DataFrame:
    return read(spark, d, "sections").select(F.explode("top_concepts").alias("c"), F.col("transformation_index").alias("t")).select("c.concept", "t")


def _weights(spark, d) -> DataFrame:
    """(term, weight): the mean transformation index of the sections that name a word in a concept."""
    return _concept_words(spark, d).where("t is not null").select(F.explode(F.split("concept", " ")).alias("term"), "t").groupBy("term").agg(F.avg("t").alias("weight"))


def _relations(spark, d) -> DataFrame:
    """(concept, source, target, strength): each word's first relation; the two words of a concept are related."""
    rows = _concept_words(spark, d).where(F.contains("concept", F.lit(" "))).select(F.split_part("concept", F.lit(" "), F.lit(1)).alias("source"), F.split_part("concept", F.lit(" "), F.lit(2)).alias("target")).distinct()
    rows = rows.withColumn("strength", F.lit(1.0)).withColumn("place", F.concat_ws(" ", "source", "target"))
    concepts = rows.select(F.explode(F.array("source", "target")).alias("concept"))
    return ontology.first_relation(rows, concepts, "place")


def _terms(spark, d, n: int, *keep: str) -> DataFrame:
    most = terms.top_terms(read(spark, d, "documents"), "doc_id", "text", 2 * n, *keep)
    return terms.key_terms(most, n, _weights(spark, d), _relations(spark, d).select(F.col("concept").alias("term")))


@query(f"WITH {S.key_terms(30)} SELECT id AS doc_id, term, tf, round(score, 6) AS score, rank FROM terms")
def key_terms_top30(spark, d):
    return _terms(spark, d, 30).select(F.col("id").alias("doc_id"), "term", "tf", F.round("score", 6).alias("score"), big(F.col("rank")).alias("rank"))


_MARKS = ("comma", "semicolon", "colon", "dash", "quote", "parenthesis")


@query(f"WITH {S.profile()} SELECT id AS doc_id, n_words, n_sentences, {', '.join(f'round({c}, 6) AS {c}' for c in stylometry.SCALARS)}, {', '.join(_MARKS)} FROM prof")
def stylometry_profile(spark, d):
    p = stylometry.profiles(read(spark, d, "documents"), "doc_id", "text").where("n_words > 0")
    return p.select(F.col("id").alias("doc_id"), big(F.col("n_words")).alias("n_words"), big(F.col("n_sentences")).alias("n_sentences"), *[F.round(c, 6).alias(c) for c in stylometry.SCALARS], *_MARKS)


@query(f"WITH x AS (SELECT doc_id, {S.words('text')} AS ws FROM documents) SELECT doc_id, f.word, round(len(list_filter(ws, lambda v: v = f.word)) / len(ws), 6) AS share FROM x, (SELECT unnest({S.quoted(lexicon.FUNCTION_WORDS)}) AS word) f WHERE len(ws) > 0")
def function_word_freq(spark, d):
    rows = stylometry.function_word_shares(read(spark, d, "documents"), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), "word", F.round("share", 6).alias("share"))


@query(f"WITH {S.profile('source')} SELECT source, count(*) AS documents, {', '.join(f'round(avg({c}), 6) AS {c}' for c in stylometry.SCALARS)} FROM prof GROUP BY source")
def author_profiles(spark, d):
    means = stylometry.mean_profiles(stylometry.profiles(read(spark, d, "documents"), "doc_id", "text", "source"), "source")
    return means.select("source", "documents", *[F.round(c, 6).alias(c) for c in stylometry.SCALARS])


_PARTS_SQL = " + ".join(f"(1 - abs(m.{c} - f.{c}) / {scale}) * {weight}" for c, (weight, scale) in lexicon.STYLE_PARTS.items())


@query(f"""WITH {S.profile('source')}, m AS (SELECT source, {', '.join(f'avg({c}) AS {c}' for c in stylometry.SCALARS)} FROM prof GROUP BY source),
x AS (SELECT source, {S.words('text')} AS ws FROM documents), sh AS (SELECT source, g.word, len(list_filter(ws, lambda v: v = g.word)) / len(ws) AS share FROM x, (SELECT unnest({S.quoted(lexicon.FUNCTION_WORDS)}) AS word) g WHERE len(ws) > 0),
wm AS (SELECT source, word, avg(share) AS share FROM sh GROUP BY ALL), al AS (SELECT a.source, avg(1 - abs(a.share - b.share)) AS alike FROM wm a JOIN wm b ON a.word = b.word AND b.source = '{FOCAL}' GROUP BY a.source),
t AS (SELECT m.source, al.alike * 0.3 + {_PARTS_SQL} AS s FROM m JOIN al ON al.source = m.source, (SELECT * FROM m WHERE source = '{FOCAL}') f)
SELECT source, round(greatest(0, least(1, s)), 6) AS similarity, round(s, 6) AS unclamped FROM t""")
def style_similarity(spark, d):
    docs = read(spark, d, "documents")
    means = stylometry.mean_profiles(stylometry.profiles(docs, "doc_id", "text", "source"), "source")
    found = stylometry.compare_to(means, stylometry.function_word_shares(docs, "doc_id", "text", "source"), "source", FOCAL)
    return found.select("source", F.round("similarity", 6).alias("similarity"), F.round("unclamped", 6).alias("unclamped"))


_CHANGES = ", ".join(f"abs({c} - lag({c}) OVER w) / nullif(lag({c}) OVER w, 0) AS d_{c}" for c in stylometry.SCALARS)
_DRIFT_SQL = f"""{S.profile('source, coalesce(year, 1900) AS year').replace('SELECT id, source, coalesce(year, 1900) AS year, len', 'SELECT id, source, year, len')}, {S.key_terms(15)},
ta AS (SELECT id, list(term ORDER BY term) AS ts FROM terms GROUP BY id), pt AS (SELECT prof.*, coalesce(ts, []) AS ts FROM prof LEFT JOIN ta USING (id)),
lagged AS (SELECT id, source, year, ts, lag(id) OVER w AS previous, lag(ts) OVER w AS before, {_CHANGES} FROM pt WINDOW w AS (PARTITION BY source ORDER BY year, id)),
drift AS (SELECT *, 1 - len(list_intersect(ts, before)) / nullif(len(list_distinct(list_concat(ts, before))), 0) AS term_change, len(list_filter(ts, lambda t: NOT list_contains(before, t))) AS new_terms, len(list_filter(before, lambda t: NOT list_contains(ts, t))) AS lost_terms FROM lagged WHERE previous IS NOT NULL)"""


def _drift(spark, d) -> DataFrame:
    docs = read(spark, d, "documents").withColumn("year", F.coalesce("year", F.lit(1900)))
    prof = stylometry.profiles(docs, "doc_id", "text", "source", "year")
    lists = _terms(spark, d, 15).groupBy("id").agg(F.collect_list("term").alias("terms"))
    return stylometry.style_drift(prof, lists, "source", ["year", "id"]).join(docs.select(F.col("doc_id").alias("id"), "year"), "id")


@query(f"WITH {_DRIFT_SQL} SELECT id AS doc_id, source, previous, round(term_change, 6) AS term_change, new_terms, lost_terms, {', '.join(f'round(d_{c}, 6) AS d_{c}' for c in stylometry.SCALARS)} FROM drift")
def style_drift(spark, d):
    rows = _drift(spark, d)
    return rows.select(F.col("id").alias("doc_id"), "source", "previous", F.round("term_change", 6).alias("term_change"), big(F.col("new_terms")).alias("new_terms"), big(F.col("lost_terms")).alias("lost_terms"), *[F.round(f"d_{c}", 6).alias(f"d_{c}") for c in stylometry.SCALARS])


_KINDS = " UNION ALL ".join([f"SELECT id, '{k}' AS kind, {c} AS change FROM later WHERE {c} > {lim}" for k, c, lim in [("terms", "term_change", 0.3), *[(c, f"d_{c}", 0.1) for c in stylometry.SCALARS]]])


@query(f"WITH {_DRIFT_SQL}, later AS (SELECT * FROM drift QUALIFY row_number() OVER (PARTITION BY source ORDER BY year, id) > 1) SELECT id AS doc_id, kind, round(change, 6) AS change FROM ({_KINDS})")
def drift_events(spark, d):
    found = stylometry.drift_events(_drift(spark, d), "source", ["year", "id"])
    return found.select(F.col("id").alias("doc_id"), "kind", F.round("change", 6).alias("change"))


# --- ontology -------------------------------------------------------------------------------------


@query(f"SELECT DISTINCT doc_id, unnest({S.concept_hits('text')}) AS concept FROM documents WHERE text IS NOT NULL")
def thesaurus_match(spark, d):
    return ontology.thesaurus_match(read(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


@query(f"""WITH s AS (SELECT doc_id, {S.sentences('text')} AS ss FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, unnest(range(0, len(ss))) AS pos, unnest(ss) AS sentence FROM s),
o AS (SELECT doc_id, pos, list_extract({S.concept_hits('sentence')}, 1) AS own FROM r),
c AS (SELECT doc_id, pos, last_value(own IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS concept, own IS NOT NULL AS own FROM o)
SELECT doc_id, pos, concept, own FROM c WHERE concept IS NOT NULL""")
def concept_carry_forward(spark, d):
    rows = ontology.sentence_concepts(read(spark, d, "documents"), "doc_id", "text")
    return rows.select(F.col("id").alias("doc_id"), big(F.col("pos")).alias("pos"), "concept", "own")


@query(f"""WITH n AS (SELECT doc_id, lower(text) AS low, t.term FROM documents, (SELECT unnest({S.quoted(NEEDLES)}) AS term) t WHERE contains(lower(text), t.term)),
p AS (SELECT doc_id, term, list_transform(string_split(low, term), lambda x: length(x)) AS ls FROM n),
s AS (SELECT doc_id, term, list_transform(range(1, len(ls)), lambda i: list_sum(list_slice(ls, 1, i)) + (i - 1) * length(term)) AS st FROM p),
o AS (SELECT doc_id, term, unnest(range(0, len(st))) AS occurrence, unnest(st)::BIGINT AS start FROM s)
SELECT o.doc_id, o.term, o.occurrence, o.start, md5(substr(d.text, greatest(o.start - 100, 0) + 1, o.start + length(o.term) + 100 - greatest(o.start - 100, 0))) AS context_md5 FROM o JOIN documents d ON d.doc_id = o.doc_id""")
def concept_occurrences(spark, d):
    rows = occurrences.find_occurrences(read(spark, d, "documents"), "doc_id", "text", NEEDLES)
    return rows.select(F.col("id").alias("doc_id"), "term", big(F.col("occurrence")).alias("occurrence"), big(F.col("start")).alias("start"), F.md5("context").alias("context_md5"))


def _vectors(spark, d) -> DataFrame:
    rows = read(spark, d, "concept_vectors").where(V.is_vector(F.col("embedding"))).select("vec_id", "kind", "label", V.align_width(F.col("embedding"), 64).alias("vector"))
    return rows.where(V.norm(F.col("vector")) > 0)


def _shift(spark, d, least: int = 5) -> DataFrame:
    """Over the groups of embeddings: a label is a concept, its first vector the original."""
    rows = read(spark, d, "embeddings").select("vec_id", F.col("label").cast("string").alias("concept"), F.col("embedding").alias("vector"))
    first = rows.groupBy("concept").agg(F.min_by("vector", "vec_id").alias("vector"))
    return occurrences.shift_index(rows, first, least)


def _shift_sql(least: int = 5) -> str:
    return f"""con AS (SELECT vec_id, label::VARCHAR AS label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), orig AS (SELECT label, arg_min(v, vec_id) AS o FROM con GROUP BY label),
shift AS (SELECT con.label AS concept, 1 - avg({S.cosine('v', 'o')}) AS transformation_index, count(*) AS occurrences FROM con JOIN orig ON orig.label = con.label GROUP BY con.label HAVING count(*) >= {least})"""


_SHIFT = _shift_sql()


@query(f"WITH {_SHIFT} SELECT concept, round(transformation_index, 6) AS transformation_index, occurrences FROM shift")
def shift_index(spark, d):
    return _shift(spark, d).select("concept", F.round("transformation_index", 6).alias("transformation_index"), "occurrences")


@query(f"WITH {_SHIFT} SELECT concept, round(transformation_index, 6) AS transformation_index, occurrences FROM shift ORDER BY round(transformation_index, 9) DESC, concept LIMIT 10")
def top_shifted(spark, d):
    rows = occurrences.top_shifted(_shift(spark, d).withColumn("transformation_index", F.round("transformation_index", 9)), 10)
    return rows.select("concept", F.round("transformation_index", 6).alias("transformation_index"), "occurrences")


@query(f"WITH {_shift_sql(50)} SELECT c.concept, round(coalesce(s.transformation_index, 1), 6) AS transformation_index, coalesce(s.occurrences, 0) AS occurrences, s.concept IS NOT NULL AS analysed FROM (SELECT DISTINCT label::VARCHAR AS concept FROM embeddings) c LEFT JOIN shift s ON s.concept = c.concept")
def combine_stages(spark, d):
    concepts = read(spark, d, "embeddings").select(F.col("label").cast("string").alias("concept"))
    return ontology.combine_stages(concepts, _shift(spark, d, 50)).withColumn("transformation_index", F.round("transformation_index", 6))


@query(f"WITH {S.VECTORS} SELECT vec_id, len(v) AS width, round(sqrt(list_dot_product(v, v)), 4) AS norm FROM vec")
def align_dim(spark, d):
    return read(spark, d, "concept_vectors").where(V.is_vector(F.col("embedding"))).select("vec_id", V.align_width(F.col("embedding"), 64).alias("v")).select("vec_id", big(F.size("v")).alias("width"), F.round(V.norm(F.col("v")), 4).alias("norm"))


_EMB = "e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)"
_PAIRS = f"""e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
pairs AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, {S.cosine('a.v', 'b.v')} AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE {S.cosine('a.v', 'b.v')} > 0.25)"""


def _pairs(spark, d) -> DataFrame:
    """Each label is a document whose concepts are its vectors."""
    rows = read(spark, d, "embeddings")
    unit = retrieval.unit_rows(rows, "vec_id", "embedding", 64).join(rows.select(F.col("vec_id").alias("id"), F.col("label").alias("group")), "id")
    return retrieval.related_within(unit, 0.25, "int")


@query(f"WITH {_PAIRS} SELECT label, a, b, round(cosine, 6) AS cosine FROM pairs")
def concept_pairs(spark, d):
    return _pairs(spark, d).select(F.col("group").alias("label"), "a", "b", F.round("cosine", 6).alias("cosine"))


@query(f"""WITH {_PAIRS}, r AS (SELECT a AS source, b AS target, round(cosine, 6) AS strength FROM pairs), ends AS (SELECT source, target, strength, unnest([source, target]) AS concept FROM r)
SELECT concept, source, target, strength FROM ends QUALIFY row_number() OVER (PARTITION BY concept ORDER BY strength DESC, source, target) = 1""")
def relation_first_match(spark, d):
    relations = _pairs(spark, d).select(F.col("a").alias("source"), F.col("b").alias("target"), F.round("cosine", 6).alias("strength"))
    return ontology.first_relation(relations, read(spark, d, "embeddings").select(F.col("vec_id").alias("concept")))


def _knn(spark, d) -> DataFrame:
    rows = read(spark, d, "concept_vectors")
    stated = retrieval.unit_rows(rows.where("kind = 'section' and vec_id % 50 = 0"), "vec_id", "embedding", 64)
    return retrieval.top_k(stated, retrieval.unit_rows(rows.where("kind = 'concept'"), "vec_id", "embedding", 64), 5)


_KNN = f"""{S.VECTORS}, near AS (SELECT q.vec_id AS id, c.vec_id AS other, {S.cosine('q.v', 'c.v')} AS cosine FROM unit q JOIN unit c ON q.kind = 'section' AND q.vec_id % 50 = 0 AND c.kind = 'concept'),
knn AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(cosine, 9) DESC, other) AS rank FROM near QUALIFY rank <= 5)"""


@query(f"WITH {_KNN} SELECT id, other, round(cosine, 6) AS cosine, rank FROM knn")
def knn_concepts(spark, d):
    return _knn(spark, d).select("id", "other", F.round("cosine", 6).alias("cosine"), big(F.col("rank")).alias("rank"))


@query(f"WITH {_KNN} SELECT id, left(string_agg(label, ' ' ORDER BY rank), 60) AS context FROM knn JOIN concept_vectors v ON v.vec_id = knn.other WHERE rank <= 3 GROUP BY id")
def rag_context(spark, d):
    return retrieval.context(_knn(spark, d).where("rank <= 3"), read(spark, d, "concept_vectors"), "vec_id", "label", 60)


# --- network --------------------------------------------------------------------------------------

_COOC = f"""{S.key_terms(8)}, ty AS (SELECT terms.id, term, year FROM terms JOIN documents ON doc_id = id WHERE year IS NOT NULL),
pair AS (SELECT a.term AS t1, b.term AS t2, count(*) AS count, min(a.year) AS first_year, max(a.year) AS last_year, list_sort(list(DISTINCT a.year)) AS years FROM ty a JOIN ty b ON a.id = b.id AND a.term < b.term GROUP BY a.term, b.term),
cooc AS (SELECT pair.*, count * (1 + (last_year - first_year) * CAST(0.01 AS DOUBLE)) * CASE WHEN x.concept IS NULL OR y.concept IS NULL THEN CAST(1 AS DOUBLE)
 ELSE 1 + CAST(0.2 AS DOUBLE) * ((x.source = y.source OR x.source = y.target)::INT + (x.target = y.target OR x.target = y.source)::INT) END AS weight FROM pair LEFT JOIN rels x ON x.concept = t1 LEFT JOIN rels y ON y.concept = t2)"""


def _cooc(spark, d) -> DataFrame:
    return network.cooccurrence(_terms(spark, d, 8, "year").where("year is not null"), relations=_relations(spark, d))


@query(f"WITH {_COOC} SELECT t1, t2, count, first_year, last_year, round(weight, 6) AS weight FROM cooc")
def cooccurrence(spark, d):
    return _cooc(spark, d).select("t1", "t2", "count", "first_year", "last_year", F.round("weight", 6).alias("weight"))


_DEG = "deg AS (SELECT term, count(*) AS degree FROM (SELECT t1 AS term FROM cooc UNION ALL SELECT t2 FROM cooc) GROUP BY term)"


@query(f"WITH {_COOC}, {_DEG} SELECT t1, t2, count, round(count / (a.degree + b.degree), 6) AS share FROM cooc JOIN deg a ON a.term = t1 JOIN deg b ON b.term = t2")
def cooc_normalised(spark, d):
    return network.normalised(_cooc(spark, d)).withColumn("share", F.round("share", 6))


@query(f"WITH {_COOC}, {_DEG} SELECT term, degree FROM deg WHERE degree > 2")
def node_degrees(spark, d):
    return network.degrees(_cooc(spark, d)).where("degree > 2")


@query(f"WITH {S.key_terms(15, 'source')} SELECT DISTINCT source AS author, terms.term, round(coalesce(weight, 1), 6) AS weight FROM terms LEFT JOIN tw ON tw.term = terms.term WHERE source IS NOT NULL")
def text_concept_edges(spark, d):
    return network.text_concept_edges(_terms(spark, d, 15, "source").where("source is not null"), "source", _weights(spark, d)).withColumn("weight", F.round("weight", 6))


_FOCAL = f"foc AS (SELECT DISTINCT term FROM terms JOIN documents ON doc_id = id WHERE source = '{FOCAL}')"


def _focal_terms(spark, d) -> DataFrame:
    return _terms(spark, d, 8, "source").where(F.col("source") == FOCAL).select("term").distinct()


@query(f"WITH {_COOC}, {_FOCAL}, ends AS (SELECT t1 AS concept, t2 AS connection, weight, years FROM cooc UNION ALL SELECT t2, t1, weight, years FROM cooc) SELECT concept, row_number() OVER (PARTITION BY concept ORDER BY round(weight, 9) DESC, connection) AS rank, connection, round(weight, 6) AS weight, array_to_string(years, ',') AS years FROM ends WHERE concept IN (FROM foc) QUALIFY rank <= 5")
def unique_patterns(spark, d):
    rows = network.unique_patterns(_cooc(spark, d), _focal_terms(spark, d))
    return rows.select("concept", big(F.col("rank")).alias("rank"), "connection", F.round("weight", 6).alias("weight"), F.array_join(F.transform("years", lambda y: y.cast("string")), ",").alias("years"))


@query(f"WITH {S.key_terms(8, 'source')}, n AS (SELECT DISTINCT term FROM terms WHERE source = '{FOCAL}') SELECT term FROM n")
def focal_neighbours(spark, d):
    """The neighbours of the focal author's node in the network of texts and concepts."""
    edges = network.text_concept_edges(_terms(spark, d, 8, "source").where("source is not null"), "source").select(F.col("author").alias("t1"), F.col("term").alias("t2"))
    return network.neighbours(edges, spark.range(1).select(F.lit(FOCAL).alias("term")))


@query(f"WITH {S.key_terms(8)}, {_FOCAL} SELECT foc.term AS concept, round(coalesce(weight, 1), 6) AS transformation, source, target FROM foc LEFT JOIN tw ON tw.term = foc.term LEFT JOIN rels ON rels.concept = foc.term")
def pattern_ranking(spark, d):
    return network.patterns_by_shift(_focal_terms(spark, d), _weights(spark, d), _relations(spark, d)).withColumn("transformation", F.round("transformation", 6))


@query(f"WITH {_COOC}, {_FOCAL} SELECT t1, t2, round(weight, 6) AS weight FROM cooc WHERE t1 IN (FROM foc) AND t2 IN (FROM foc) AND weight > 1.1")
def focal_edges(spark, d):
    return network.induced(_cooc(spark, d), _focal_terms(spark, d), 1.1).select("t1", "t2", F.round("weight", 6).alias("weight"))


@query("SELECT source AS author, max_by(year, struct_pack(y := year, i := doc_id)) AS year FROM documents WHERE source IS NOT NULL AND year IS NOT NULL GROUP BY source")
def author_nodes(spark, d):
    return network.last_attributes(read(spark, d, "documents").where("source is not null and year is not null"), "source", "year", "doc_id")


# --- history --------------------------------------------------------------------------------------

_EVENTS = ", ".join("({}, '{}')".format(y, e.replace("'", "''")) for y, e in lexicon.EVENTS)
_PERIODS = ", ".join(f"({a}, {b}, '{n}')" for a, b, n in lexicon.PERIODS)


@query(f"WITH e(y, e) AS (VALUES {_EVENTS}) SELECT doc_id, year, coalesce((SELECT string_agg(e, ',' ORDER BY y, e) FROM e WHERE y <= year), '') AS events FROM documents WHERE year IS NOT NULL")
def event_context(spark, d):
    rows = evolution.events_until(read(spark, d, "documents").where("year is not null"), "doc_id", "year")
    return rows.select(F.col("id").alias("doc_id"), "year", F.array_join("events", ",").alias("events"))


@query(f"WITH p(a, b, period) AS (VALUES {_PERIODS}), {S.key_terms(10)}, x AS (SELECT period, term, count(*) AS count FROM terms JOIN documents ON doc_id = id JOIN p ON year BETWEEN a AND b GROUP BY ALL) SELECT period, term, count, row_number() OVER (PARTITION BY period ORDER BY count DESC, term) AS rank FROM x QUALIFY rank <= 10")
def period_concepts(spark, d):
    rows = evolution.in_periods(_terms(spark, d, 10, "year"), "year")
    return evolution.most_common(rows, "period", "term", 10).withColumn("rank", big(F.col("rank")))


_VOLUME_YEAR = "CASE volume_id " + " ".join(f"WHEN {v} THEN {y}" for v, y in lexicon.VOLUME_YEARS.items()) + " ELSE 1893 + (volume_id - 1) * CAST(0.56 AS DOUBLE) END"


def _timeline(spark, d) -> DataFrame:
    return read(spark, d, "sections").where("volume_id is not null").groupBy("volume_id").agg(F.count("*").alias("sections"), F.avg("transformation_index").alias("avg_transformation"))


@query(f"SELECT volume_id, round(({_VOLUME_YEAR})::DOUBLE, 4) AS year, count(*) AS sections, round(avg(transformation_index), 6) AS avg_transformation FROM sections WHERE volume_id IS NOT NULL GROUP BY volume_id")
def volume_timeline(spark, d):
    return _timeline(spark, d).select("volume_id", F.round(T.year_of_volume(F.col("volume_id")), 4).alias("year"), "sections", F.round("avg_transformation", 6).alias("avg_transformation"))


@query("WITH v AS (SELECT volume_id, avg(transformation_index) AS a FROM sections WHERE volume_id IS NOT NULL GROUP BY volume_id), l AS (SELECT volume_id, a - lag(a) OVER (ORDER BY volume_id) AS delta FROM v) SELECT volume_id, round(delta, 6) AS delta FROM l WHERE abs(delta) > 0.02")
def turning_points(spark, d):
    return evolution.turning_points(_timeline(spark, d), "avg_transformation", 0.02).select("volume_id", F.round("delta", 6).alias("delta"))


@query("""WITH c AS (SELECT volume_id, unnest(top_concepts).concept AS concept FROM sections WHERE volume_id IS NOT NULL), f AS (SELECT concept, volume_id, count(*) AS frequency FROM c GROUP BY ALL)
SELECT concept, min(volume_id) AS first_volume, max(volume_id) AS last_volume, round((arg_max(frequency, volume_id) - arg_min(frequency, volume_id)) / greatest(1, arg_min(frequency, volume_id)) * 100, 4) AS change_percent FROM f GROUP BY concept HAVING count(*) > 1""")
def long_term_trends(spark, d):
    rows = read(spark, d, "sections").where("volume_id is not null").select("volume_id", F.explode("top_concepts").alias("c")).groupBy(F.col("c.concept").alias("concept"), "volume_id").agg(F.count("*").alias("frequency"))
    return evolution.long_term_trends(rows, 1).withColumn("change_percent", F.round("change_percent", 4))


# --- datasets -------------------------------------------------------------------------------------


@query(f"""WITH w AS (SELECT doc_id, {S.words('text')} AS ws FROM documents), i AS (SELECT doc_id, ws, unnest(range(0, (len(ws) - 1) // 64 + 1)) AS part FROM w WHERE len(ws) > 0),
s AS (SELECT doc_id, part, list_slice(ws, part * 64 + 1, part * 64 + 64) AS p FROM i) SELECT doc_id, part, md5(array_to_string(p, ' ')) AS md5, len(p) AS n FROM s WHERE len(p) >= 16""")
def chunk_windows(spark, d):
    rows = chunking.token_windows(read(spark, d, "documents"), "doc_id", "text", 64, 16)
    return rows.select(F.col("id").alias("doc_id"), big(F.col("window")).alias("part"), F.md5("text").alias("md5"), big(F.col("n")).alias("n"))


@query()
def recursive_chunks(spark, d):
    return chunking.recursive_chunks(read(spark, d, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_SYSTEM = "Ответ в двух предложениях."


@query(f"SELECT DISTINCT run_id, md5('<|begin_of_text|>' || '<|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || '{_SYSTEM}<|eot_id|>' || chr(10) || '<|start_header_id|>user<|end_header_id|>' || chr(10) || chr(10) || prompt || '<|eot_id|>' || chr(10) || '<|start_header_id|>assistant<|end_header_id|>' || chr(10) || chr(10) || response || '<|eot_id|>' || chr(10)) AS md5 FROM parameter_results WHERE prompt IS NOT NULL AND response IS NOT NULL")
def chat_template(spark, d):
    rows = read(spark, d, "parameter_results").where("prompt is not null and response is not null")
    return rows.select("run_id", F.md5(dialogs.chat_text(_SYSTEM, F.col("prompt"), F.col("response"))).alias("md5")).distinct()


@query("SELECT DISTINCT id, md5(coalesce(title, '') || chr(10) || left(coalesce(content, ''), 300)) AS md5 FROM news")
def news_prompts(spark, d):
    return read(spark, d, "news").select("id", F.md5(dialogs.news_prompt(F.col("title"), F.col("content"), 300)).alias("md5")).distinct()


# --- tables ---------------------------------------------------------------------------------------

_ORDER = "created_at, url, title, content"
_CUT = "TIMESTAMP '2024-09-01 00:00:00'"


def _order() -> list:
    return ["created_at", "url", "title", "content"]


@query(f"SELECT id, source, created_at FROM news WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) = 1")
def dedupe_first(spark, d):
    return store.dedupe_first(read(spark, d, "news"), ["id"], _order()).select("id", "source", "created_at")


def _halves(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = read(spark, d, "news")
    old = F.col("created_at") < F.expr(_CUT.replace("TIMESTAMP", "TIMESTAMP_NTZ"))
    return store.dedupe_first(rows.where(old), ["id"], _order()), rows.where(~old)


_HALVES = f"old AS (SELECT * FROM news WHERE created_at < {_CUT} AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) = 1), new AS (SELECT * FROM news WHERE NOT created_at < {_CUT} AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) = 1)"


@query(f"WITH {_HALVES} SELECT id, created_at, processed FROM old UNION ALL SELECT id, created_at, processed FROM new WHERE id NOT IN (SELECT id FROM old)")
def insert_ignore(spark, d):
    old, new = _halves(spark, d)
    return store.insert_ignore(old, new, ["id"], _order()).select("id", "created_at", "processed")


@query(f"WITH {_HALVES} SELECT coalesce(o.id, n.id) AS id, coalesce(o.created_at, n.created_at) AS created_at, CASE WHEN n.id IS NOT NULL THEN n.processed_at ELSE o.processed_at END AS processed_at FROM old o FULL JOIN new n ON o.id = n.id")
def upsert(spark, d):
    old, new = _halves(spark, d)
    return store.upsert(old, new, ["id"], _order(), keep=("created_at",)).select("id", "created_at", "processed_at")


@query(f"WITH {_HALVES} SELECT o.id, coalesce(n.source, o.source) AS source, o.created_at FROM old o LEFT JOIN (SELECT id, source || '*' AS source FROM new WHERE source IS NOT NULL) n ON o.id = n.id")
def bulk_update(spark, d):
    old, new = _halves(spark, d)
    change = store.dedupe_first(new.where("source is not null"), ["id"], _order()).select("id", F.concat("source", F.lit("*")).alias("source"))
    return store.bulk_update(old, change, ["id"], ["source"]).select("id", "source", "created_at")


@query("SELECT id, url, CASE WHEN processed THEN NULL ELSE processed_at END AS processed_at FROM news WHERE NOT coalesce(source IS NULL AND processed, false) AND id NOT IN (SELECT news_id FROM analysis WHERE analysis IS NULL AND news_id IS NOT NULL)")
def update_and_delete(spark, d):
    rows = store.delete_where(read(spark, d, "news"), F.col("source").isNull(), F.col("processed"))
    rows = store.delete_keys(rows, read(spark, d, "analysis").where("analysis is null").select(F.col("news_id").alias("id")))
    return store.update_where(rows, F.col("processed"), {"processed_at": F.lit(None).cast("timestamp_ntz")}).select("id", "url", "processed_at")


@query("SELECT id, date FROM (SELECT DISTINCT id, date FROM news WHERE NOT processed) ORDER BY date DESC, id LIMIT 10")
def pending_newest(spark, d):
    rows = read(spark, d, "news").where(~F.col("processed")).select("id", "date").distinct()
    return store.newest(rows, F.lit(True), "date", "id", 10)


@query("SELECT a.news_id, n.date FROM (SELECT DISTINCT news_id FROM analysis WHERE NOT published) a JOIN (SELECT id, min(date) AS date FROM news GROUP BY id) n ON n.id = a.news_id ORDER BY n.date DESC, a.news_id LIMIT 10")
def unpublished_join(spark, d):
    due = read(spark, d, "analysis").where("not published").select("news_id").distinct()
    dated = read(spark, d, "news").groupBy(F.col("id").alias("news_id")).agg(F.min("date").alias("date"))
    return store.newest(due.join(dated, "news_id"), F.lit(True), "date", "news_id", 10).select("news_id", "date")


@query("SELECT source, count(DISTINCT id) AS items FROM news GROUP BY source")
def stream_ingest(spark, d):
    """The news table as a stream, each id once, all that is there; the result is the stored table counted."""
    path = f"{d}/news.parquet"
    source = path if os.path.isdir(path) else d
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet" if os.path.isdir(path) else "news.parquet").parquet(source)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream/{uuid.uuid4().hex}"
    stream.dropDuplicates(["id"]).writeStream.format("parquet").option("path", f"{base}/table").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{base}/table").groupBy("source").agg(F.count_distinct("id").alias("items"))


# --- sweeps and profiles --------------------------------------------------------------------------


@query("SELECT " + ", ".join(f"{k}.{k}" for k in lexicon.PARAMETER_GRID) + " FROM " + ", ".join(f"(SELECT unnest([{', '.join(f'CAST({v} AS DOUBLE)' if isinstance(v, float) else str(v) for v in vs)}]) AS {k}) {k}" for k, vs in lexicon.PARAMETER_GRID.items()))
def param_grid(spark, d):
    return sweep.grid(spark)


_OK = "error IS NULL AND tokens > 0"
_FAST = "tokens / nullif(gen_time, 0)"


@query(f"WITH r AS (SELECT DISTINCT * FROM parameter_results) SELECT model_name, count(*) AS runs, count_if({_OK}) AS passed, round(avg(CASE WHEN {_OK} THEN {_FAST} END), 6) AS mean_speed, round(avg(CASE WHEN {_OK} THEN load_time END), 6) AS mean_load, arg_min(run_id, struct_pack(s := -{_FAST}, i := run_id)) FILTER (WHERE {_OK} AND gen_time <> 0) AS fastest_run, arg_min(run_id, struct_pack(v := max_vram, i := run_id)) FILTER (WHERE {_OK} AND max_vram IS NOT NULL) AS leanest_run FROM r GROUP BY model_name")
def sweep_summary(spark, d):
    rows = sweep.summary(read(spark, d, "parameter_results").distinct(), ["model_name"])
    return rows.withColumn("mean_speed", F.round("mean_speed", 6)).withColumn("mean_load", F.round("mean_load", 6))


@query(f"SELECT model_name, round(max(CASE WHEN {_OK} AND gpu_layers > 0 THEN {_FAST} END), 6) AS best_gpu, round(max(CASE WHEN {_OK} AND gpu_layers = 0 THEN {_FAST} END), 6) AS best_cpu, round(max(CASE WHEN {_OK} AND gpu_layers > 0 THEN {_FAST} END) / nullif(max(CASE WHEN {_OK} AND gpu_layers = 0 THEN {_FAST} END), 0), 6) AS ratio FROM parameter_results GROUP BY model_name")
def gpu_speed_up(spark, d):
    rows = sweep.speed_up(read(spark, d, "parameter_results"), "model_name")
    return rows.select("model_name", *[F.round(c, 6).alias(c) for c in ("best_gpu", "best_cpu", "ratio")])


@query(r"""WITH k AS (SELECT unnest(json_keys(props)) AS key, props FROM events), v AS (SELECT key, props ->> ('$.' || key) AS value FROM k)
SELECT key, CASE WHEN value IS NULL THEN 'null' WHEN regexp_matches(value, '^\s*\{') THEN 'object' WHEN regexp_matches(value, '^\s*\[') THEN 'array' WHEN value IN ('true', 'false') THEN 'boolean' WHEN regexp_full_match(value, '-?\d+') THEN 'integer' WHEN regexp_full_match(value, '-?\d+(\.\d+)?([eE][+-]?\d+)?') THEN 'number' ELSE 'string' END AS kind, count(*) AS documents, left(min(value), 100) AS sample FROM v GROUP BY ALL""")
def json_profile(spark, d):
    return profile.json_profile(read(spark, d, "events"), "props")


@query("SELECT event_type, count(*) AS rows, min(ts) AS first, max(ts) AS last, date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days FROM events GROUP BY event_type")
def event_stats(spark, d):
    return profile.date_span(read(spark, d, "events"), "event_type", "ts").withColumn("days", big(F.col("days")))


@query("SELECT source, count(*) AS rows, min(date) AS first, max(date) AS last, date_diff('day', min(date)::DATE, max(date)::DATE) AS days FROM news GROUP BY source")
def feed_stats(spark, d):
    return profile.date_span(read(spark, d, "news"), "source", "date").withColumn("days", big(F.col("days")))


# --- filters, picks, dialogs, round trips ----------------------------------------------------------


@query(r"SELECT doc_id, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 1000 AS focal, length(regexp_replace(text, '^\s+|\s+$', '', 'g')) > 500 AS reference FROM documents WHERE text IS NOT NULL")
def length_filters(spark, d):
    t = F.col("text")
    return read(spark, d, "documents").where("text is not null").select("doc_id", T.long_enough(t, 1000).alias("focal"), T.long_enough(t, 500).alias("reference"))


@query(r"WITH c AS (SELECT unnest(concepts) AS c FROM documents UNION ALL SELECT filename[1:4] FROM documents UNION ALL SELECT year::VARCHAR FROM documents) SELECT c AS concept, count(*) AS times FROM c WHERE length(c) BETWEEN 3 AND 50 AND NOT regexp_full_match(c, '\d+') GROUP BY c")
def concept_filter(spark, d):
    docs = read(spark, d, "documents")
    rows = docs.select(F.explode("concepts").alias("c")).unionAll(docs.select(F.left("filename", F.lit(4)))).unionAll(docs.select(F.col("year").cast("string")))
    return rows.where(T.sane_concept(F.col("c"))).groupBy(F.col("c").alias("concept")).agg(F.count("*").alias("times"))


@query(r"SELECT source, count(*) AS items FROM news WHERE regexp_matches(content, '\S') GROUP BY source")
def messages_with_text(spark, d):
    return read(spark, d, "news").where(T.has_text(F.col("content"))).groupBy("source").agg(F.count("*").alias("items"))


@query(f"WITH n AS (SELECT id, source FROM news WHERE id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY {_ORDER}) = 1), a AS (SELECT news_id, analysis, published FROM analysis QUALIFY row_number() OVER (PARTITION BY news_id ORDER BY created_at, analysis) = 1) SELECT id, source, md5(analysis) AS analysis_md5, published FROM n LEFT JOIN a ON a.news_id = n.id")
def loaded_relationship(spark, d):
    items = store.dedupe_first(read(spark, d, "news"), ["id"], _order()).select("id", "source")
    rows = store.load_relationship(items, store.dedupe_first(read(spark, d, "analysis"), ["news_id"], ["created_at", "analysis"]), "id", "news_id", "loaded")
    return rows.select("id", "source", F.md5("loaded.analysis").alias("analysis_md5"), "loaded.published")


_MARKS_SQL = " UNION ALL ".join(f"SELECT doc_id, '{k}' AS kind, unnest(regexp_extract_all(text, '{p.replace('(?iu)', '(?i)')}')) AS mark FROM documents" for k, p in lexicon.STRUCTURE_PATTERNS.items())


@query(f"WITH m AS ({_MARKS_SQL}) SELECT doc_id, kind, md5(mark) AS mark_md5, count(*) AS times FROM m GROUP BY ALL")
def structure_marks(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(T.structure_marks(F.col("text"))).alias("m"))
    return rows.groupBy("doc_id", F.col("m.kind").alias("kind"), F.md5("m.mark").alias("mark_md5")).agg(F.count("*").alias("times"))


_CODES = {"f16": 1, "q4": 2, "q5": 8, "q8": 7}


@query("SELECT DISTINCT model_name, CASE split_part(model_name, '-', 3) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in _CODES.items()) + f" END AS code FROM parameter_results WHERE split_part(model_name, '-', 3) IN ({', '.join(repr(k) for k in _CODES)})")
def format_codes(spark, d):
    rows = read(spark, d, "parameter_results").select("model_name", F.split_part("model_name", F.lit("-"), F.lit(3)).alias("part")).where(F.col("part").isin(list(_CODES))).distinct()
    return rows.select("model_name", T.code_of(F.upper("part"), _CODES).alias("code"))


@query("SELECT split_part(model_name, '-', 1) AS family, arg_min(model_name, struct_pack(r := CASE WHEN contains(model_name, 'q4') THEN 0 WHEN contains(model_name, 'f16') THEN 1 ELSE 2 END, s := length(model_name), n := model_name)) AS picked FROM parameter_results WHERE model_name IS NOT NULL GROUP BY ALL")
def preferred_files(spark, d):
    rows = read(spark, d, "parameter_results").where("model_name is not null").select("model_name").distinct()
    rank, size = T.preferred(F.col("model_name"), F.length("model_name"), ["q4", "f16"])
    return rows.groupBy(F.split_part("model_name", F.lit("-"), F.lit(1)).alias("family")).agg(F.min_by("model_name", F.struct(rank.alias("r"), size.alias("s"), "model_name")).alias("picked"))


@query(f"WITH e(y, e) AS (VALUES {', '.join(f"({y}, '{e.replace(chr(39), chr(39) * 2)}')" for y, e in lexicon.EVENTS)}) SELECT doc_id, md5('[' || year || ': ' || coalesce((SELECT string_agg(e, '; ' ORDER BY y, e) FROM e WHERE y <= year), '') || '] ' || left(text, 40)) AS md5 FROM documents WHERE year IS NOT NULL AND text IS NOT NULL")
def contextual_texts(spark, d):
    docs = read(spark, d, "documents").where("year is not null and text is not null")
    known = evolution.events_until(docs, "doc_id", "year").select(F.col("id").alias("doc_id"), "events")
    return docs.join(known, "doc_id").select("doc_id", F.md5(T.contextual(F.left("text", F.lit(40)), F.col("year"), F.col("events"))).alias("md5"))


@query()
def named_entities(spark, d):
    rows = read(spark, d, "documents").select("doc_id", F.explode(T.entities(F.col("text"))).alias("entity"))
    return rows.groupBy("entity").agg(F.count("*").alias("documents"))


@query()
def hashed_embeddings(spark, d):
    """The stand-in embedder over all texts."""
    return read(spark, d, "documents").where("text is not null").select("doc_id", V.hashed_bag(T.tokens(F.col("text"))).alias("embedding"))


@query("SELECT section_id, round(list_avg(list_transform(list_slice(list_reverse_sort(list_transform(top_concepts, lambda c: c.similarity)), 1, 50), lambda x: x)), 6) AS section_index FROM sections WHERE len(top_concepts) > 0")
def section_index(spark, d):
    return occurrences.section_index(read(spark, d, "sections"), "section_id", "top_concepts", 50).select(F.col("id").alias("section_id"), F.round("section_index", 6).alias("section_index"))


@query(f"WITH x AS (SELECT source, {S.words('text')} AS ws FROM documents) SELECT source, f.word, round(avg(len(list_filter(ws, lambda v: v = f.word)) / len(ws)), 6) AS share FROM x, (SELECT unnest({S.quoted(lexicon.FUNCTION_WORDS)}) AS word) f WHERE len(ws) > 0 GROUP BY source, f.word")
def author_function_words(spark, d):
    shares = stylometry.mean_shares(stylometry.function_word_shares(read(spark, d, "documents"), "doc_id", "text", "source"), "source")
    return shares.select("source", F.explode("shares").alias("word", "share")).withColumn("share", F.round("share", 6))


@query(f"WITH k AS (SELECT volume_id, section_id, section_text FROM sections WHERE volume_id IS NOT NULL AND section_text IS NOT NULL AND len({_REASONS_SQL}) = 0) SELECT volume_id || '_' || row_number() OVER (PARTITION BY volume_id ORDER BY section_id) AS numbered, md5(section_text) AS md5 FROM k")
def numbered_sections(spark, d):
    rows = read(spark, d, "sections").where("volume_id is not null and section_text is not null").select(F.col("volume_id").alias("id"), F.col("section_id").alias("part"), F.col("section_text").alias("section"))
    return chunking.kept_sections(rows).select(F.col("section_id").alias("numbered"), F.md5("section").alias("md5"))


@query("SELECT DISTINCT run_id, md5('<|im_start|>user' || chr(10) || prompt || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) || response || '<|im_end|>' || chr(10)) AS md5 FROM parameter_results WHERE prompt IS NOT NULL AND response IS NOT NULL")
def chatml(spark, d):
    rows = read(spark, d, "parameter_results").where("prompt is not null and response is not null")
    return rows.select("run_id", F.md5(dialogs.chatml_text([("user", F.col("prompt")), ("assistant", F.col("response"))])).alias("md5")).distinct()


@query("SELECT DISTINCT run_id, len(list_filter(['труд', 'капитал', 'рынок'], lambda k: contains(lower(response), k)))::BIGINT AS hits, 'assistant' AS last_role FROM parameter_results WHERE prompt IS NOT NULL AND response IS NOT NULL")
def conversations(spark, d):
    """Turns of a conversation and the expected keywords in its answer."""
    rows = read(spark, d, "parameter_results").where("prompt is not null and response is not null")
    rows = rows.select("run_id", dialogs.conversation(_SYSTEM, F.col("prompt"), F.col("response")).alias("turns"), dialogs.keyword_hits(F.col("response"), F.array(*[F.lit(k) for k in ("Труд", "капитал", "рынок")])).alias("hits"))
    return rows.select("run_id", big(F.col("hits")).alias("hits"), F.element_at("turns", -1)["role"].alias("last_role")).distinct()


def _folder(spark) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"


@query("SELECT id, source, md5(title) AS title_md5 FROM news")
def io_json_lines(spark, d):
    """Written as JSON lines and read back."""
    path = _folder(spark)
    sinks.write_json_lines(read(spark, d, "news").select("id", "source", "title"), path)
    return readers.json_lines(spark, path, "id string, source string, title string").select("id", "source", F.md5("title").alias("title_md5"))


@query("SELECT gpu_layers, count(*) AS runs, round(sum(temperature), 4) AS temperature, round(sum(load_time), 4) AS load_time FROM parameter_results GROUP BY gpu_layers")
def io_csv(spark, d):
    path = _folder(spark)
    sinks.write_csv(read(spark, d, "parameter_results").select("run_id", "gpu_layers", "temperature", "load_time"), path)
    rows = readers.csv_table(spark, path, "run_id bigint, gpu_layers int, temperature double, load_time double")
    return rows.groupBy("gpu_layers").agg(F.count("*").alias("runs"), F.round(F.sum("temperature"), 4).alias("temperature"), F.round(F.sum("load_time"), 4).alias("load_time"))


@query("SELECT section_id, volume_id, year, md5(section_text) AS md5 FROM sections")
def io_documents(spark, d):
    """Written as pretty JSON texts without null fields and read by an explicit schema."""
    path = _folder(spark)
    sinks.write_document(read(spark, d, "sections").select("section_id", "volume_id", "year", "section_text"), path)
    rows = readers.json_sequence(spark, path, "section_id string, volume_id int, year double, section_text string")
    return rows.select("section_id", "volume_id", "year", F.md5("section_text").alias("md5"))


@query("SELECT vec_id, kind FROM concept_vectors")
def io_collection(spark, d):
    """A vector collection, rebuilt as a whole in partitions by kind."""
    path = _folder(spark)
    sinks.write_collection(read(spark, d, "concept_vectors").select("vec_id", "kind", "embedding"), path, "vec_id", "kind")
    return spark.read.parquet(path).select("vec_id", "kind")


@query()
def tfidf_components(spark, d):
    return terms.tfidf_svd(read(spark, d, "documents"), "doc_id", "text", 10, 500).withColumnRenamed("id", "doc_id")


# --- extensions: plain relational queries over the star schema ------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def ext_pricing_summary(spark, d):
    rows = read(spark, d, "lineitem").where(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02 00:00:00'"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc_price"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order"))


@query("SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def ext_local_supplier_volume(spark, d):
    c, o, li, s, n = (read(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation"))
    rows = li.join(o, li.l_orderkey == o.o_orderkey).join(c, c.c_custkey == o.o_custkey).join(s, (li.l_suppkey == s.s_suppkey) & (c.c_nationkey == s.s_nationkey)).join(n, s.s_nationkey == n.n_nationkey)
    return rows.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_hourly_events(spark, d):
    return read(spark, d, "events").groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 4).alias("total"))
