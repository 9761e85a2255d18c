"""Pieces of DuckDB SQL for the twins of the queries; written on their own, not derived from the plans."""

from __future__ import annotations

from lexiflow.functions import lexicon


def quoted(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def words(text: str) -> str:
    return rf"list_filter(string_split_regex({text}, '\s+'), lambda w: w <> '')"


def clean(text: str) -> str:
    return rf"trim(regexp_replace(lower(regexp_replace({text}, '[^а-яА-ЯёЁ\s\-]', '', 'g')), '\s+', ' ', 'g'))"


def tokens(text: str) -> str:
    return f"list_filter(string_split({clean(text)}, ' '), lambda w: length(w) > 2 and not list_contains({quoted(lexicon.STOP_WORDS)}, w))"


def sentences(text: str) -> str:
    return rf"list_filter(list_transform(string_split_regex({text}, '[.!?]'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '')"


def squeeze(text: str) -> str:
    return rf"trim(regexp_replace({text}, '\s+', ' ', 'g'))"


#: Transformation index and relations of the words of the sections' concepts, which have two words; the first relation by source and target.
CONTEXT = """wc AS (SELECT unnest(top_concepts).concept AS concept, transformation_index AS t FROM sections WHERE top_concepts IS NOT NULL),
tw AS (SELECT term, avg(t) AS weight FROM (SELECT unnest(string_split(concept, ' ')) AS term, t FROM wc WHERE t IS NOT NULL) GROUP BY term),
relation AS (SELECT DISTINCT split_part(concept, ' ', 1) AS source, split_part(concept, ' ', 2) AS target FROM wc WHERE contains(concept, ' ')),
rels AS (SELECT * FROM (SELECT source, target, unnest(list_distinct([source, target])) AS concept FROM relation) QUALIFY row_number() OVER (PARTITION BY concept ORDER BY source, target) = 1)"""


def key_terms(n: int, extra: str = "") -> str:
    """CTEs up to ``terms`` (id, term, tf, score, rank, extra columns of documents)."""
    more = f", {extra}" if extra else ""
    return f"""{CONTEXT}, tok AS (SELECT doc_id AS id{more}, unnest(list_filter(flatten(list_transform({tokens('text')}, lambda t: string_split(t, '-'))), lambda t: length(t) >= 2)) AS term FROM documents),
tf AS (SELECT id{more}, term, count(*) AS tf FROM tok GROUP BY ALL),
most AS (SELECT * FROM tf QUALIFY row_number() OVER (PARTITION BY id ORDER BY tf DESC, term) <= {2 * n}),
scored AS (SELECT most.*, coalesce(weight, 1) * CASE WHEN concept IS NULL THEN CAST(1 AS DOUBLE) ELSE CAST(1.3 AS DOUBLE) END AS score FROM most LEFT JOIN tw ON tw.term = most.term LEFT JOIN rels ON rels.concept = most.term),
terms AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, term) AS rank FROM scored QUALIFY rank <= {n})"""


def profile(extra: str = "") -> str:
    """CTEs up to ``prof``: the stylometric profile of every document with words."""
    more = f", {extra}" if extra else ""
    return rf"""parts AS (SELECT doc_id AS id{more}, text, {sentences('text')} AS sents, {words('text')} AS ws, list_filter(string_split(text, chr(10) || chr(10)), lambda p: regexp_matches(p, '\S')) AS paras FROM documents),
prof AS (SELECT id{more}, len(ws) AS n_words, len(sents) AS n_sentences,
 coalesce(list_sum(list_transform(sents, lambda s: len(list_filter(string_split_regex(s, '\s+'), lambda w: w <> '')))) / nullif(len(sents), 0), 0)::DOUBLE AS sentence_length,
 len(list_distinct(ws)) / len(ws) AS lexical_diversity,
 list_sum(list_transform(ws, lambda w: length(w))) / len(ws) AS word_length,
 coalesce(list_sum(list_transform(paras, lambda p: len(string_split_regex(p, '[.!?]')))) / nullif(len(paras), 0), 0)::DOUBLE AS paragraph_length,
 length(text) - length(replace(text, ',', '')) AS comma, length(text) - length(replace(text, ';', '')) AS semicolon, length(text) - length(replace(text, ':', '')) AS colon,
 length(text) - length(replace(text, '—', '')) AS dash, length(text) - length(replace(replace(text, '"', ''), '''', '')) AS quote, length(text) - length(replace(replace(text, '(', ''), ')', '')) AS parenthesis
 FROM parts WHERE len(ws) > 0)"""


def concept_hits(text: str) -> str:
    """List of the dictionary's concepts named in a text, in its order."""
    cases = []
    for concept, terms in lexicon.THESAURUS.items():
        any_ = " OR ".join(f"contains(lower({text}), '{t}')" for t in dict.fromkeys([concept, *terms]))
        cases.append(f"CASE WHEN {any_} THEN '{concept}' END")
    return f"list_filter([{', '.join(cases)}], lambda c: c IS NOT NULL)"


VECTORS = """vec AS (SELECT vec_id, kind, label, list_transform(list_resize(embedding, 64, CAST(0 AS FLOAT)), lambda x: CAST(x AS DOUBLE)) AS v FROM concept_vectors
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, kind, label, v FROM vec WHERE list_dot_product(v, v) > 0)"""


def cosine(a: str, b: str) -> str:
    return f"(list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))))"
