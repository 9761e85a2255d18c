"""Template residue, filler, error pages and script notices in documents, by a multi-pattern automaton.

One automaton holds multilingual phrases of all kinds. Its matches are laid over the text, and for
every sentence that holds a core phrase the covered part of its letters is measured. A sentence
that a kind covers highly *is* such a message; prose that merely quotes or mentions one is covered
little and stays. Filler is also told by its form (one word again and again, keyboard rows, mock
Latin without function words), and placeholders by their delimiters.

Placeholders are found by the same automaton: it holds the marks that open a field, and at each of
them the forms of unfilled fields are tried.

A document gets the kind with the most matched letters, and ``coverage``: the residue's part of all
its letters. ``without_residue`` leaves out the documents that are residue for the better part and
marks those in which it stands within content.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import col, spread

#: Core phrases tell the kind; the others only add to the coverage of a sentence. Lower case, yo as ye.
CORE = {
    "error_page": (
        "страница не найдена|доступ запрещен|доступ закрыт|внутренняя ошибка сервера|ошибка сервера|плохой шлюз|ошибочный шлюз|время ожидания шлюза истекло|время ожидания истекло|"
        "сервис временно недоступен|сервер временно недоступен|сайт временно недоступен|слишком много запросов|превышен предел обращений|превышен лимит запросов|такого адреса на сайте нет|"
        "такой страницы не существует|запрашиваемая страница не существует|у вас нет прав на просмотр|недостаточно прав|вышестоящий узел прислал неверный ответ|сервер не смог обработать запрос|на сайте идут технические работы|"
        "ведутся технические работы|запрошенный документ удален|страница была удалена|идентификатор обращения|произошла непредвиденная ошибка|ошибка подключения к базе данных|не удалось подключиться к базе данных|попробуйте обновить страницу позже|"
        "page not found|the requested url|was not found on this server|internal server error|bad gateway|gateway timeout|gateway time-out|service unavailable|service temporarily unavailable|access denied|"
        "too many requests|fatal error|call to undefined|database error|error establishing a database connection|could not connect|connection refused|traceback (most recent call last)|uncaught exception|unhandled exception|"
        "upstream host did not answer|an unexpected error occurred|you don't have permission to access|"
        "seite nicht gefunden|interner serverfehler|zugriff verweigert|dienst nicht verfügbar|bitte prüfen sie die adresse|page introuvable|accès refusé|erreur interne du serveur|service indisponible|"
        "сторінку не знайдено|доступ заборонено|внутрішня помилка сервера|сервіс тимчасово недоступний"
    ),
    "script_notice": (
        "включите javascript|включить javascript|включен javascript|включенным javascript|включите поддержку javascript|активируйте javascript|активируйте java-скрипты|разрешите выполнение сценариев|разрешите javascript|"
        "включить поддержку скриптов|включите скрипты|отключены сценарии|сценарии отключены|скрипты отключены|javascript отключен|javascript выключен|сценарии не разрешены|требуется javascript|необходим javascript|"
        "enable javascript|enable js|requires javascript|javascript is disabled|javascript is required|turn on javascript|does not run scripts|does not support javascript|enable scripts|"
        "aktivieren sie javascript|javascript aktivieren|javascript ist deaktiviert|javascript wird benötigt|activer javascript|activez javascript|javascript est désactivé|увімкніть javascript|увімкнути javascript|javascript вимкнено"
    ),
    "filler": (
        "здесь будет текст|здесь будет описание|тут будет текст|текст-заполнитель|текст заполнитель|заглушка: содержимое не добавлено|текст будет позже|описание появится позже|описание будет позже|содержимое не добавлено|содержание появится позже|"
        "пример текста для проверки верстки|текст для проверки верстки|замените его своим|замените этот текст|замените текст|sample paragraph|sample text|dummy text|placeholder text|replace this text with your own|your text here|text goes here|content coming soon|"
        "hier steht ihr text|beispieltext|platzhaltertext|texte d'exemple|votre texte ici|texte à remplacer|тут буде текст|приклад тексту"
    ),
}
AROUND = {
    "error_page": "ошибка|упс|код|вернитесь на главную|проверьте адрес|и повторите попытку|администратор уже извещен|раздела|страницу|или перемещен|попробуйте|позже|http|errno|not found|function|in line|on line|undefined|please try again in|minutes|seconds|erreur|retour à l’accueil|retour à l'accueil|fehler|error|the|sorry",
    "script_notice": "для работы сайта|чтобы продолжить|чтобы читать материал|для просмотра страницы|для просмотра|для работы|требуется браузер с|необходимо|и обновите страницу|в браузере|в вашем браузере|поэтому содержимое не показано|часть материала недоступна|пока|please|to view this page|to load the article text|you need to|this site|and cookies to continue|and cookies|to continue|your browser|bitte|um diese seite zu lesen|veuillez|pour afficher le contenu|у вашому браузері|будь ласка",
    "filler": "раздела|пункт|не для печати|раздел",
}
KEYBOARD = "asdf|asdfg|asdfgh|qwer|qwert|qwerty|zxcv|zxcvb|фыва|фывап|йцук|йцукен|олдж|ячсм|ячсмить"
MOCK_LATIN = "lorem|ipsum"
FUNCTION_WORDS = frozenset("и в на не что с по как из the of and to in is that for der die das und ist le la les des et est que и та що не".split())

NAME = r"[^\W\d][\w.:\-]*(?: [\w.:\-]+){0,3}"
#: Words that ask for a field to be filled, and usual names of fields (lower case; also taken in capitals).
FILL_IN = "вставить|вставьте|указать|укажите|заполнить|заполните|вписать|впишите|insert|fill in|todo|tbd|ausfüllen|einfügen|eintragen|à remplir|à compléter|insérer|вставити|вказати|заповнити"
FIELDS = (
    "имя|фамилия|отчество|фио|дата|время|тема|сумма|заголовок|название|город|адрес|телефон|должность|организация|подпись|номер|автор|том|"
    "title|name|author|date|time|subject|topic|amount|sum|city|address|phone|email|body|volume|number|company|signature|"
    "titel|vorname|nachname|datum|betreff|betrag|stadt|adresse|unterschrift|nom|prénom|titre|objet|montant|ville|прізвище|назва|місто|сума|адреса|підпис"
)
#: After a fill-in word in lower case these go on with prose, not with a field.
NO_FIELD = r"(?!(?:на|в|во|что|как|с|со|к|по|о|об|за|им|ему|ей|that|how|into|to|in)\b)"
PLACEHOLDER = re.compile(
    rf"\{{\{{\s*{NAME}\s*\}}\}}|\{{%\s*{NAME}[^%\n]{{0,60}}%\}}|<%[=\-]?\s*{NAME}[^%\n]{{0,60}}%>|[$#]\{{\s*{NAME}\s*\}}|(?<![{{$#])\{{\s*[^\W\d][\w.\-]*\s*\}}(?!\}})"
    rf"|\[\[\s*{NAME}\s*\]\]|@@{NAME}@@|%\({NAME}\)[sdf]|(?<!\w)%[^\W\d][\w.]{{2,}}%(?!\w)"
    rf"|(?:<|&lt;)\s*(?:ВАШ\w*|ваш\w*|YOUR|your|INSERT|IHR|VOTRE)[ _]{NAME}\s*(?:>|&gt;)|&lt;\s*(?!/|(?:b|i|u|p|a|br|hr|em|li|ul|ol|td|tr|th|div|span|strong|table|img|sup|sub|h[1-6]|code|pre|noscript|script)\b)[^\W\d][\w.]*\s*&gt;"
    rf"|\[(?:ВСТАВИТЬ|ВСТАВЬТЕ|УКАЗАТЬ|ЗАПОЛНИТЬ|INSERT|FILL IN|YOUR|TODO|TBD)(?::| )\s*{NAME}\]"
    rf"|\[\s*(?i:{FILL_IN})\s*(?::\s*[^\W\d][^\[\]\n]*|\s(?i:{NO_FIELD}){NAME}\s*)\]|\[\s*[^\W\d][^\[\]\n]*[—–:\-]\s*(?i:{FILL_IN})\s*\]|\[\s*(?i:your|ihr|votre)[ _](?i:{FIELDS})\s*\]"
    rf"|(?:<|&lt;)\?(?!(?i:xml))(?:=|php\b)?\s*(?:echo\s+)?\$?[^\W\d](?:[^?<\n]|\?(?!>|&gt;))*\?(?:>|&gt;)"
    rf"|(?<!_)_{{3,}}+[ \t]*\([ \t]*[^\W\d_][^()\n]*\)|(?<!\w)__(?!name__)(?:[^\W\d_]+[._])*(?:{FIELDS}|{FIELDS.upper()})__(?!\w|\s*=)",
)
#: What a field may start with.
OPENERS = ("{", "$", "#", "%", "@@", "<", "&lt;", "[", "__")
AGAIN = re.compile(r"(?<!\w)([^\W\d]\w+)(?:\W+\1){4,}(?!\w)")
CUT = re.compile(r"(?<=[.!?…])[»”\"')\]]*\s+|\n+|</?[a-z]+>")
LETTERS = re.compile(r"[^\W\d_]")


def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for core, group in ((True, CORE), (False, AROUND)):
        for kind, phrases in group.items():
            for p in phrases.split("|"):
                entries.setdefault(p, []).append((kind, core))
    for p in KEYBOARD.split("|"):
        entries.setdefault(p, []).append(("keyboard", True))
    for p in MOCK_LATIN.split("|"):
        entries.setdefault(p, []).append(("mock", True))
    for p in OPENERS:
        entries.setdefault(p, []).append(("field", False))
    for p, kinds in entries.items():
        a.add_word(p, (len(p), kinds))
    a.make_automaton()
    return a


class ResidueFinder:
    """Finds residue in one text: ``find`` gives (kind, matched letters, all letters) or None."""

    def __init__(self, coverage: float = 0.6):
        self.automaton, self.coverage = _automaton(), coverage

    def find(self, text: str) -> tuple[str, int, int] | None:
        low = text.lower().replace("ё", "е")
        if len(low) != len(text):
            text = low
        sums: dict[str, int] = {}
        hits = list(self.automaton.iter(low))
        fields = sorted(end - n + 1 for end, (n, kinds) in hits if kinds == [("field", False)])
        hits = [(end - n + 1, end + 1, kinds) for end, (n, kinds) in hits if kinds != [("field", False)] and not (end - n >= 0 and low[end - n].isalpha()) and not low[end + 1 : end + 2].isalpha()]
        if any(core for _, _, kinds in hits for _, core in kinds):
            bounds = [0, *(m.end() for m in CUT.finditer(low)), len(low)]
            at = 0
            for start, stop in zip(bounds, bounds[1:]):
                own = []
                while at < len(hits) and hits[at][0] < stop:
                    own.append(hits[at])
                    at += 1
                if own and any(core for _, _, kinds in own for _, core in kinds):
                    self._sentence(low[start:stop], start, own, sums)
        for m in AGAIN.finditer(low):
            sums["filler"] = sums.get("filler", 0) + len(LETTERS.findall(m.group()))
        done = 0
        for start in fields:
            if start >= done and (m := PLACEHOLDER.match(text, start)):
                sums["placeholder"] = sums.get("placeholder", 0) + len(LETTERS.findall(m.group()))
                done = m.end()
        if not sums:
            return None
        kind = max(sums, key=lambda k: (sums[k], k))
        return kind, sums[kind], len(LETTERS.findall(text))

    def _sentence(self, sentence: str, start: int, hits: list, sums: dict[str, int]) -> None:
        total = len(LETTERS.findall(sentence))
        core = {kind for _, _, kinds in hits for kind, c in kinds if c}
        if "keyboard" in core and sum(1 for _, _, kinds in hits if ("keyboard", True) in kinds) >= 2:
            sums["filler"] = sums.get("filler", 0) + total
        if "mock" in core and FUNCTION_WORDS.isdisjoint(re.findall(r"\w+", sentence)):
            sums["filler"] = sums.get("filler", 0) + total
        for kind in core - {"keyboard", "mock"}:
            marked = bytearray(len(sentence) + 1)
            for a, b, kinds in hits:
                if any(k == kind for k, _ in kinds):
                    a, b = max(0, a - start), min(len(sentence), b - start)
                    marked[a:b] = b"\x01" * (b - a)
            covered = sum(1 for i, ch in enumerate(sentence) if marked[i] and ch.isalpha())
            if covered >= self.coverage * total:
                sums[kind] = sums.get(kind, 0) + covered


def residue(df: DataFrame, id_col: str, text_col: str, *, coverage: float = 0.6) -> DataFrame:
    """(id, residue, coverage): the texts that hold residue, with one kind each.

    ``coverage`` is the least part of a sentence's letters that phrases of one kind must cover. Null
    and empty texts hold none; a null id stays null; repeated rows come out once. Ties between kinds
    go to the later name. Other columns of ``df`` are never read.
    """
    base = spread(df.select(col(id_col).alias("id"), col(text_col).alias("text"))).where(F.length("text") > 0)
    kind = base.schema["id"].dataType.simpleString()

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = ResidueFinder(coverage)
        for b in batches:
            found = [finder.find(t) for t in b["text"]]
            keep = [f is not None for f in found]
            if any(keep):
                yield pd.DataFrame({"id": b["id"][keep], "residue": [f[0] for f in found if f], "coverage": [min(1.0, f[1] / max(1, f[2])) for f in found if f]})

    return base.mapInPandas(find, f"id {kind}, residue string, coverage double").distinct()


def without_residue(df: DataFrame, id_col: str, text_col: str, *, coverage: float = 0.6, exclude_from: float = 0.5) -> DataFrame:
    """(id, residue, coverage): the texts to keep; residue is null, or the kind that stands within content.

    Left out is a text whose residue covers at least ``exclude_from`` of its letters. Null and empty
    texts are kept, repeated rows come out once. The texts themselves are not carried.
    """
    found = residue(df, id_col, text_col, coverage=coverage).select(F.col("id").alias("found"), "residue", "coverage")
    per_id = found.groupBy("found").agg(F.max(F.struct("coverage", "residue")).alias("r"))
    ids = df.select(col(id_col).alias("id")).distinct()
    rows = ids.join(per_id, F.col("id").eqNullSafe(F.col("found")), "left")
    return rows.where(F.coalesce(F.col("r.coverage") < exclude_from, F.lit(True))).select("id", "r.residue", F.coalesce("r.coverage", F.lit(0.0)).alias("coverage"))
