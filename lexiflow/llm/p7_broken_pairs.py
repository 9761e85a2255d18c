"""Defective question-answer pairs by labelling functions and an expectation-maximisation label model.

For every defect several noisy labelling functions, each on evidence of its own, vote 1 (defective),
0 (not) or -1 (abstain). A label model estimates by EM how often each function votes 1 on defective and
on sound pairs, from the counts of vote patterns over all pairs (a few dozen numbers per defect,
however many the pairs), and gives every pattern the posterior of the defect.

The cutoff of a defect is validated on planted pairs: of every pair on which no
function votes (`quiet`), pairs of every defect are made whose defect is known (an answer emptied, refused in one of the stated
sentences, replaced by its question or by a stated answer in another language, cut inside a word). They are voted on beside
the pair itself and only counted. The cutoff is the
posterior of best F1 on them; what the functions and the model reach on them is reported. The language model has the
trigrams of all labelled texts. Every
label beyond its cutoff is kept; the first of them by posterior, then by the order of ``DEFECTS``,
is the pair's defect.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, col, spread, words
from lexiflow.llm.p5_truncation import NOTHING

DEFECTS = ("empty", "refusal", "copy", "language", "truncated")
VOTES = {"empty": 3, "refusal": 4, "copy": 3, "language": 3, "truncated": 4}
#: Refusals that are planted for validation; none of them is taken from the data.
PLANTED_REFUSALS = ("Я не могу дать ответ на такой вопрос.", "К сожалению, мы не можем обсуждать подобные темы.", "I cannot answer this question.", "Sorry, we are unable to help with this request.", "Ich kann dazu leider nichts sagen.", "Je ne peux pas répondre à cette demande.", "На жаль, не можу відповісти на це запитання.")

#: Answers that are planted where the question is in another language; none of them is taken from the data.
PLANTED_ANSWERS = (
    "Рост цен в этом году связывают с плохим урожаем. По мнению наблюдателей, к осени положение может стать лучше.",
    "The rise in prices this year is put down to a poor harvest. Observers think that things may look better by the autumn.",
    "Der Anstieg der Preise in diesem Jahr wird mit einer schlechten Ernte erklärt. Beobachter meinen, dass es im Herbst besser werden kann.",
    "La hausse des prix cette année s'explique par une mauvaise récolte. Les observateurs pensent que la situation peut s'améliorer à l'automne.",
    "Зростання цін цього року пов'язують з поганим урожаєм. На думку спостерігачів, восени становище може стати кращим.",
)

REFUSAL = re.compile(
    r"не (?:могу|можем|смогу|сумею|вправе|берусь|готов) (?:\w+ ){0,3}(?:ответить|отвечать|обсуждать|судить|помочь|выполнить|комментировать|дать|оценить|оценивать|подготовить)|не берусь (?:\w+ )?(?:судить|отвечать|оценивать)|воздержусь от|(?:мне|нам) не разрешено|(?:мне|нам) запрещено|"
    r"дать не имею права|не имею права|выходит за рамки (?:моих|наших|моей)|за рамками моих|(?:подготовить|сформировать|составить|дать) (?:\w+ ){0,3}(?:не получится|не вышло|не удалось)|ответа нет|обработка запроса прервана|ответ (?:\w+ )?не (?:создан|получен|сформирован)|повторите обращение|"
    r"\b(?:i|we) (?:am |are )?(?:can ?not|can't|cannot|won't|will not|am unable to|are unable to|unable to|must decline|have to decline|decline to)\b|i'd rather not|i would rather not|have to decline|outside what i am allowed|not allowed to|against my (?:rules|guidelines|policy)|no answer (?:was|could be) (?:produced|generated)|"
    r"(?:kann|darf|möchte|werde) (?:ich |dazu |darauf |diese \w+ |die \w+ ){0,3}(?:leider )?(?:nicht|keine)|je ne (?:peux|suis|puis)|je refuse|je préfère ne pas|не можу (?:відповісти|обговорювати|допомогти)|утримаюсь від|не маю права"
)
APOLOGY = re.compile(r"^\W*(?:к сожалению|извините|увы|сожалею|прошу прощения|простите|приношу извинения|я лишь программа|как языковая модель|sorry|i am sorry|i'm sorry|unfortunately|i apologi[sz]e|as an? (?:ai|language)|leider|entschuldigung|désolé|malheureusement|на жаль|вибачте|перепрошую)\b")
REDIRECT = re.compile(r"уточните формулировку|задать другой вопрос|обратитесь к специалисту|могу помочь с чем|спасибо за понимание|ask something else|anything else|rephrase|another question|consult a|eine andere frage|autre question|поставте інше питання")
TAG = re.compile(r"</?[A-Za-z][^<>]{0,40}>|&(?:[A-Za-z]{2,8}|#\d{1,6});")
QUOTED = re.compile(r"«[^»]*»|“[^”]*”|\"[^\"]*\"")
LEAD = re.compile(r"\W*[^\W_]+\s*[:.]\s")
LETTERS = re.compile(r"[^\W\d_]+")
SENTENCE = re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+|\n+")


class LanguageModel:
    """Naive Bayes over letter trigrams, from their counts in labelled texts by language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        counts = {k: v for k, v in counts.items() if sum(v.values()) >= 200}
        self.languages = sorted(counts)
        grams = sorted(set().union(*counts.values()))
        self.place = {g: i for i, g in enumerate(grams)}
        # Logarithms by trigram and language; in the last row those of a trigram that none of them has.
        self.logs = np.zeros((len(grams) + 1, len(self.languages)))
        #: Words met so far, by their place in ``sums``, the sums of the rows of their trigrams; begun anew when it is full.
        self.met: dict[str, int] = {}
        self.sums = np.zeros((20_000, len(self.languages)))
        for j, k in enumerate(self.languages):
            seen = np.array([counts[k].get(g, 0) for g in grams] + [0])
            self.logs[:, j] = np.log((seen + 0.5) / (seen.sum() + 0.5 * (len(grams) + 1)))

    @staticmethod
    def _grams(text: str) -> list[str]:
        flat = " " + " ".join(LETTERS.findall(text.lower())) + " "
        return [flat[i : i + 3] for i in range(len(flat) - 2)]

    def _row(self, word: str) -> int:
        at = self.met.get(word)
        if at is None:
            at = self.met[word] = len(self.met)
            self.sums[at] = self.logs[[self.place.get(g, len(self.place)) for g in self._grams(word)]].sum(axis=0)
        return at

    @lru_cache(maxsize=64)  # noqa: B019  (one model in each worker)
    def scores(self, text: str) -> dict[str, float]:
        """Mean log-likelihood per trigram and language."""
        found = LETTERS.findall(text.lower())
        if not found or not self.languages:
            return {}
        get, rest, row = self.place.get, len(self.place), self._row
        total = self.logs[[get(f"{a[-1]} {b[0]}", rest) for a, b in zip(found, found[1:])]].sum(axis=0) if found[1:] else 0
        for start in range(0, len(found), 1000):
            if len(self.met) > len(self.sums) - 1000:
                self.met.clear()
            total = total + self.sums[[row(w) for w in found[start : start + 1000]]].sum(axis=0)
        return dict(zip(self.languages, total / (sum(map(len, found)) + len(found) - 1)))

    def best(self, text: str) -> str | None:
        found = self.scores(text)
        return max(found, key=found.get) if found else None


def trigram_counts(labelled: DataFrame) -> dict[str, dict[str, int]]:
    """By language the trigrams of all its texts with their counts; the driver gets a row for each language and trigram."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[str, Counter] = {}
        for b in batches:
            for lang, texts in b.groupby("lang")["text"]:
                # Words, and the places where two of them meet, are counted first, then the trigrams of each.
                own, parts = counts.setdefault(lang, Counter()), Counter()
                for text in texts:
                    found = LETTERS.findall(text.lower())
                    parts.update(found)
                    own.update([f"{x[-1]} {y[0]}" for x, y in zip(found, found[1:])])
                for w, n in parts.items():
                    for g in LanguageModel._grams(w):
                        own[g] += n
        yield pd.DataFrame([(k, g, n) for k, v in counts.items() for g, n in v.items()], columns=["lang", "gram", "n"])

    named = spread(labelled.where("text is not null and lang is not null").select("text", "lang"))
    out: dict[str, dict[str, int]] = {}
    for r in named.mapInPandas(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect():
        out.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return out


@lru_cache(maxsize=64)
def _script(text: str) -> tuple[int, int]:
    low = text.lower()
    return sum(map(len, re.findall(r"[а-яёіїєґў]+", low))), sum(map(len, re.findall(r"[a-zà-öø-ÿß]+", low)))


@lru_cache(maxsize=64)
def _words(text: str) -> tuple[str, ...]:
    return tuple(words(text))


@lru_cache(maxsize=64)
def _stems(held: tuple[str, ...]) -> frozenset[str]:
    return frozenset(w[:5] for w in held if len(w) >= 5)


@lru_cache(maxsize=16)
def _runs(held: tuple[str, ...], n: int) -> frozenset[tuple[str, ...]]:
    return frozenset(zip(*(held[i:] for i in range(n))))


@lru_cache(maxsize=16)
def _flat(held: tuple[str, ...]) -> tuple[frozenset[str], str]:
    return frozenset(held), " " + " ".join(held) + " "


class Voter:
    """All labelling functions of one pair but those on the ending, which come from the truncation operator."""

    def __init__(self, model: LanguageModel):
        self.model = model

    def empty(self, answer: str | None) -> list[int]:
        """No word outside markup; a sign for nothing; at most one word and no sentence end."""
        bare = TAG.sub(" ", answer or "")
        sign = re.sub(r"[^\w/]+", " ", bare.lower()).strip().replace("_", "")
        return [int(not re.search(r"[^\W_]", bare)), int(not sign or sign in NOTHING), int(len(bare.split()) <= 1 and not re.search(r"\w[.!?…]", bare))]

    def refusal(self, answer: str, held: tuple[str, ...], asked: tuple[str, ...]) -> list[int]:
        """A refusing phrase outside quotation marks; an apology at the start; an offer of something else; no content word of the question."""
        low = answer.lower().replace("ё", "е")
        stems, known = _stems(held), _stems(asked)
        strong = bool(REFUSAL.search(QUOTED.sub(" ", low)))
        return [int(strong), 1 if APOLOGY.search(low) else -1 if strong else 0, 1 if REDIRECT.search(low) else -1 if strong else 0, int(stems.isdisjoint(known)) if stems and known else -1]

    def truncated(self, answer: str, mark: str, last_word: str, at_limit: float | None) -> list[int]:
        """The mark at the end; what the corpus knows of the last word; a length at a censoring limit; a bracket or quotation left open."""
        marked = 0 if mark in ("finished", "signed", "nothing") else 1 if mark in ("open", "abbreviation") else -1
        word = {"unknown": 1, "short": 1, "ends": 0}.get(last_word, -1)
        tail = answer[max(answer.rfind("\n"), 0) :]
        opened = any(tail.count(a) > tail.count(b) for a, b in ("()", "«»", "[]", "“”"))
        return [marked, word if mark != "nothing" else 0, int(at_limit > 0.5) if at_limit else -1, 1 if opened else -1]

    def copy(self, answer: tuple[str, ...], question: tuple[str, ...], answer_text: str) -> list[int]:
        # One word with a colon or stop before a repeated question only introduces it.
        if (lead := LEAD.match(answer_text)) and answer and question and answer[0] != question[0]:
            answer, answer_text = answer[1:], answer_text[lead.end() :]
        if not answer or not question:
            return [-1, -1, -1]
        n = min(4, len(answer))
        held = _runs(question, n)
        marks = bytearray(len(answer))
        for i in range(len(answer) - n + 1):
            if answer[i : i + n] in held:
                marks[i : i + n] = b"\x01" * n
        known, flat = _flat(question)
        parts = [w for s in SENTENCE.split(answer_text) if (w := words(s))]
        return [int(sum(marks) >= 0.9 * len(answer)), int(sum(w in known for w in answer) >= 0.95 * len(answer)), int(bool(parts) and sum(len(p) for p in parts if f" {' '.join(p)} " in flat) >= 0.9 * sum(map(len, parts)))]

    def language(self, answer: str, question: str) -> list[int]:
        ca, la = _script(answer)
        cq, lq = _script(question)
        if ca + la < 12 or cq + lq < 12:
            return [-1, -1, -1]
        script = int((ca > la) != (cq > lq))
        # Without a letter or likely word of another Cyrillic language both are plainly Russian.
        if not script and ca > 0.9 * (ca + la) and cq > 0.9 * (cq + lq) and not re.search("[іїєґў]", (answer + question).lower()):
            return [0, 0, 0]
        a, q = self.model.scores(answer), self.model.scores(question)
        if not a or not q:
            return [script, -1, -1]
        best_a, best_q = max(a, key=a.get), max(q, key=q.get)
        differ = int(best_a != best_q)
        clear = differ and a[best_a] - a[best_q] > 0.15 and q[best_q] - q[best_a] > 0.15
        return [script if script else -1, differ, int(bool(clear)) if clear or not differ else -1]


def label_model(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Posterior of the defect for each vote pattern, by EM over naive Bayes with mild Beta priors.

    The priors (a function fires on 0.8 of the defective and 0.01 of the sound pairs, worth ten
    pairs each) only fix which class is the defect.
    """
    n = counts.astype(float)
    share, hit, false = 0.05, np.full(patterns.shape[1], 0.8), np.full(patterns.shape[1], 0.01)
    seen, fired = patterns >= 0, patterns == 1
    posterior = np.zeros(len(patterns))
    for _ in range(rounds):
        like = []
        for p, prior in ((hit, share), (false, 1 - share)):
            like.append(np.log(prior) + np.where(seen, np.where(fired, np.log(p), np.log(1 - p)), 0).sum(1))
        posterior = 1 / (1 + np.exp(np.clip(like[1] - like[0], -500, 500)))
        d, s = n * posterior, n * (1 - posterior)
        share = float(np.clip((d.sum() + 1) / (n.sum() + 20), 1e-6, 0.5))
        hit = np.clip(((d[:, None] * fired).sum(0) + 8) / ((d[:, None] * seen).sum(0) + 10), 0.02, 0.999)
        false = np.clip(((s[:, None] * fired).sum(0) + 0.1) / ((s[:, None] * seen).sum(0) + 10), 1e-5, 0.5)
    return posterior


def votes_of(voter: Voter, question: str | None, answer: str | None, mark: str, last_word: str, at_limit: float | None) -> dict[str, str]:
    """The votes of one pair: per defect a string of x (abstains), 0 and 1."""
    answer, question = (x if isinstance(x, str) else "" for x in (answer, question))
    empty = voter.empty(answer)
    if sum(empty) >= 2:
        votes = {d: [0] * VOTES[d] for d in DEFECTS} | {"empty": empty}
    else:
        wa, wq = _words(TAG.sub(" ", answer)), _words(question)
        votes = {"empty": empty, "refusal": voter.refusal(answer, wa, wq), "copy": voter.copy(wa, wq, answer), "language": voter.language(answer, question), "truncated": voter.truncated(answer, mark, last_word, at_limit)}
    return {d: _code(votes[d]) for d in DEFECTS}


def _code(votes: list[int]) -> str:
    return "".join("x01"[v + 1] for v in votes)


def quiet(votes: dict[str, str]) -> bool:
    """Whether no function votes for an empty, copied or foreign answer, and the first ones on refusals and endings vote against."""
    return not any("1" in votes[d] for d in ("empty", "copy", "language")) and votes["refusal"][0] == "0" and votes["truncated"][:2] == "00"


def planted(voter: Voter, i: int, question: str, answer: str, own: dict[str, str]) -> list[tuple[str, dict[str, str]]]:
    """(defect or '', votes) of the pairs made of one sound pair of votes ``own``; ``i`` tells which of the stated texts and places are taken."""
    out = [("", own | {"truncated": _code(voter.truncated(answer, "finished", "ends", None))})]
    out.append(("empty", votes_of(voter, question, ("", " — ", "N/A", "<p></p>", "...")[i % 5], "nothing", "unknown", None)))
    out.append(("refusal", votes_of(voter, question, PLANTED_REFUSALS[i % len(PLANTED_REFUSALS)], "finished", "ends", None)))
    out.append(("copy", votes_of(voter, question, question if i % 2 else question.upper(), "finished", "ends", None)))
    inside = [m.start() + len(m.group()) // 2 for m in re.finditer(r"[^\W\d_]{6,}", answer)]
    if inside:
        out.append(("truncated", votes_of(voter, question, answer[: inside[i % len(inside)]], "open", "unknown" if i % 2 else "rare", None)))
    asked = voter.model.best(question)
    stated = [PLANTED_ANSWERS[(i + k) % len(PLANTED_ANSWERS)] for k in range(len(PLANTED_ANSWERS))]
    other = next((t for t in stated if voter.model.best(t) not in (asked, None)), None)
    if other and asked:
        out.append(("language", votes_of(voter, question, other, "finished", "ends", None)))
    return out


def validated_cutoff(defect: str, posterior: dict[str, float], pairs: list[tuple[str, str, int]]) -> tuple[float, float, float]:
    """(cutoff, precision, recall) on planted pairs, (defect or '', pattern, how many): the least posterior of best F1, but at least one half.

    Planted refusals, some in other languages, don't count for ``language``.
    """
    scored = [(posterior.get(pattern, 0.0), truth == defect, n) for truth, pattern, n in pairs if not (defect == "language" and truth == "refusal")]
    true = sum(n for _, t, n in scored if t)
    best = (0.5, 0.0, 0.0, -1.0)
    for cutoff in sorted({p for p, _, _ in scored if p >= 0.5} | {0.5}):
        kept = [(t, n) for p, t, n in scored if p >= cutoff - 1e-12]
        right = sum(n for t, n in kept if t)
        precision, recall = right / max(1, sum(n for _, n in kept)), right / max(1, true)
        f1 = 2 * precision * recall / max(1e-9, precision + recall)
        if f1 > best[3] + 1e-9:
            best = (cutoff, precision, recall, f1)
    return best[:3]


def _votes(pairs: DataFrame, labelled: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The votes on the pairs, and those on the planted pairs: truth (the defect or '') and n, how many have these votes."""
    shared = pairs.sparkSession.sparkContext.broadcast(Voter(LanguageModel(trigram_counts(labelled))))

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made: Counter = Counter()
        for b in batches:
            out = []
            for kind, key, question, answer, *ending in zip(*(b[c] for c in ("pair_kind", "pair_id", "question", "answer", "mark", "last_word", "at_limit"))):
                own = votes_of(shared.value, question, answer, *ending)
                out.append((kind, key, None, 1, *own.values()))
                if quiet(own) and question and answer:
                    made.update((truth, *v.values()) for truth, v in planted(shared.value, zlib.crc32(f"{kind} {key}".encode()), question, answer, own))
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame([(None, None, truth, n, *v) for (truth, *v), n in made.items()], columns=names)

    names = ["pair_kind", "pair_id", "truth", "n", *DEFECTS]
    base = spread(pairs.select("pair_kind", col("pair_id").cast("string").alias("pair_id"), "question", "answer", "mark", "last_word", "at_limit"))
    # The votes are read twice: for the counts of their patterns, and with the posteriors.
    voted = checkpointed(base.mapInPandas(vote, "pair_kind string, pair_id string, truth string, n long, " + ", ".join(f"{d} string" for d in DEFECTS)))
    return voted.where("truth is null").drop("truth", "n"), voted.where("truth is not null").drop("pair_kind", "pair_id")


def _model(votes: DataFrame, made: DataFrame) -> list[dict]:
    """Per defect: its patterns with counts and posteriors, the validated cutoff, and what it reaches on planted pairs."""
    out = []
    for d in DEFECTS:
        counted = votes.groupBy(d).agg(F.count("*").alias("n")).collect()  # at most 3 ** VOTES[d] rows
        if counted:
            patterns = [r[d] for r in counted]
            n = np.array([r["n"] for r in counted])
            p = dict(zip(patterns, map(float, label_model(np.array([["x01".index(c) - 1 for c in x] for x in patterns]), n))))
            tried = [(r["truth"], r[d], r["n"]) for r in made.groupBy("truth", d).agg(F.sum("n").alias("n")).collect()]
            cutoff, precision, recall = validated_cutoff(d, p, tried)
            out.append({"defect": d, "posterior": p, "counts": dict(zip(patterns, map(int, n))), "cutoff": cutoff, "planted": sum(n for t, _, n in tried if t == d), "precision": precision, "recall": recall})
    return out


def broken_pairs(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(pair_kind, pair_id, defect, labels, posterior) of the defective pairs.

    ``pairs`` has pair_kind, pair_id, question, answer and the ending evidence of the answer: mark and
    last_word (strings), at_limit (double). ``labelled`` has text and lang; all
    its rows that have both, whole, train the language model, and all sound pairs
    serve the validation of the cutoffs. Null answers are empty
    ones; a null or wordless question rules out ``copy`` and ``language`` only. Repeated pairs come
    out once. Empty tables give an empty result.
    """
    votes, made = _votes(pairs, labelled)
    kept = {(m["defect"], pattern): p for m in _model(votes, made) for pattern, p in m["posterior"].items() if p >= m["cutoff"] - 1e-12}
    found = F.filter(F.array(*[F.struct((-F.coalesce(_lookup(kept, d), F.lit(0.0))).alias("less"), F.lit(i).alias("place"), F.lit(d).alias("defect")) for i, d in enumerate(DEFECTS)]), lambda x: x["less"] < 0)
    labels = votes.select("pair_kind", "pair_id", F.array_sort(found).alias("found")).where(F.size("found") > 0)
    per_pair = labels.groupBy("pair_kind", "pair_id").agg(F.min("found").alias("found"))
    return per_pair.select("pair_kind", "pair_id", F.col("found")[0]["defect"].alias("defect"), F.transform("found", lambda x: x["defect"]).alias("labels"), (-F.col("found")[0]["less"]).alias("posterior"))


def agreement(pairs: DataFrame, labelled: DataFrame) -> DataFrame:
    """(defect, pairs, overruled, cutoff, planted, precision, recall): one row per defect.

    ``pairs`` counts the pairs kept, ``overruled`` those where the model and the first labelling
    function disagree; precision and recall are those on the planted pairs.
    """
    votes, made = _votes(pairs, labelled)
    rows = []
    for m in _model(votes, made):
        kept = {x for x, p in m["posterior"].items() if p >= m["cutoff"] - 1e-12}
        rows.append((m["defect"], sum(n for x, n in m["counts"].items() if x in kept), sum(n for x, n in m["counts"].items() if (x in kept) != (x[0] == "1")), m["cutoff"], m["planted"], m["precision"], m["recall"]))
    return pairs.sparkSession.createDataFrame(rows, "defect string, pairs long, overruled long, cutoff double, planted long, precision double, recall double")


def _lookup(kept: dict, defect: str):
    own = [(pattern, p) for (d, pattern), p in kept.items() if d == defect]
    if not own:
        return F.lit(None).cast("double")
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in own for x in pair]), F.col(defect))
