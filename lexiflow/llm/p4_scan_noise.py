"""Noise in text from scanned pages: running headers, page numbers, line-end hyphens, misread characters.

Page edges come first. A line of its own that holds only a number is a page number if it belongs to
a sequence rising by one with text between its members, or interrupts a sentence, or wears marks as
page numbers do, or stands between paragraphs of a text that bears other traces of a scan; plain
numbers in tables are none of these. A running header is a capitalised line that repeats, fuzzily, at page
edges: beside a page number, with a number of its own, or in the middle of a sentence. Spacing,
digits, case and look-alike characters are left aside and single wrong, missing or added letters are
forgiven. A line set without a gap between far longer lines of running text counts as well. Repetition is
counted in distinct surroundings, so copies of a text count once: on three pages of the volume, or in
three volumes, at page edges in two of them. All are absolute numbers, so a volume's headers are
found however many volumes there are.

Lines are joined into paragraphs; whether a word broken at a line end keeps its hyphen is decided by
the corpus vocabulary (how often the joined and the hyphenated form, or the first part of a
compound, occur within lines). Misread characters are words that mix scripts or hold stray marks,
and rare words that have the shape of a far more frequent word, that is, differ from it only by
letters a scanner takes for one another.

Nothing is collected or broadcast: header lines are found by joins on volume and shape and go back to their
texts as line numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import checkpointed, col, spread

#: What scanners write for Cyrillic letters, and letters they take for one another.
LOOKALIKES = {"0": "о", "3": "з", "4": "ч", "6": "б", "8": "в", "a": "а", "b": "в", "c": "с", "e": "е", "h": "н", "k": "к", "m": "м", "o": "о", "p": "р", "r": "г", "t": "т", "u": "и", "x": "х", "y": "у", "i": "і"}
GROUPS = (("/i", "л"), ("iii", "ш"), ("bi", "ы"), ("io", "ю"), ("|", ""), ("\\", ""), ("_", ""))
CONFUSED = ("оес", "тг", "инплц", "вз", "шщ", "ьъ")
#: Of these, the pairs that are taken for one another directly.
PAIRS = "ос ес тг ин нп пл цп вз шщ ьъ".split()

NUMBER_LINE = re.compile(r"^\W*(?:(?:стр|с|p|page|s|seite|л|лист)\.?\s*)?\W*(\d{1,4})\W*$", re.I)
EDGE_NUMBER = re.compile(r"^\W{0,3}\d{1,4}\W+(?=[^\W\d])|(?<=[\w»”])\W+\d{1,4}\W{0,3}$")
BREAK = re.compile(r"([\w|\\/]+(?:-[\w|\\/]+)*)[-‐­¬]\s*$")
NEXT = re.compile(r"^\s*([\w|\\/]+(?:-[\w|\\/]+)*)")
MARK = ""
HYPHENS = "-‐­¬"
#: Where a Cyrillic letter touches a character of another kind.
TOUCH = re.compile(r"[а-яёіїєґ][a-z0-9|\\_]|[a-z0-9|\\_][а-яёіїєґ]|/i[а-яёіїєґ]|[а-яёіїєґ]/i(?![a-z0-9])")
INSIDE = re.compile(r"[\w|\\/]")
TOKEN = re.compile(r"[\w|\\/]+")
CYRILLIC, OTHER = re.compile(r"[а-яёА-ЯЁіїєґІЇЄҐ]"), re.compile(r"[A-Za-z0-9|\\]")
PLAIN = re.compile(r"(?<![\w|\\/\-])[^\W\d_]{4,}(?![\w|\\/\-])")
COMPOUND = re.compile(r"(?<![\w-])[^\W\d_]{2,}(?:-[^\W\d_]{2,})+(?![\w-])")
LEAST_LETTERS, MIN_PAGES, MIN_VOLUMES = 6, 3, 3
#: What a line of running text may end with at the end of a sentence.
CLOSED = ".!?…»”:;"

_FROM, _TO = "".join(LOOKALIKES), "".join(LOOKALIKES.values())


def header_key(line: str) -> str:
    low = line.lower().replace("ё", "е").translate(str.maketrans(_FROM, _TO))
    return re.sub(r"[\W\d_]+", "", low)


_SHAPE = str.maketrans("".join(g[1:] for g in CONFUSED), "".join(g[0] * (len(g) - 1) for g in CONFUSED))


def header_shape(line: str) -> str:
    """The letters of a line, confusable ones read as one; '' if the line can't be a running header."""
    if not line or line[-1] in ".!?…,;:-¬" or "|" in line:
        return ""
    bare = EDGE_NUMBER.sub("", line).strip()
    if not bare or not (bare[0].isupper() or bare[0].isdigit()) or any(c in ",;:" for c in bare):
        return ""
    key = header_key(bare)
    return key.translate(_SHAPE) if len(key) >= LEAST_LETTERS else ""


def _interrupts(before: str, after: str) -> bool:
    """Whether what stands between two lines stands in the middle of a sentence."""
    return bool(before and after) and before[-1] not in CLOSED and (after[0].islower() or before[-1] in HYPHENS)


def page_numbers(lines: list[str], headers: set[int] = frozenset()) -> set[int]:
    """Which of the stripped lines are page numbers; the first line of a text never is."""
    filled = [i for i, s in enumerate(lines) if s]
    numbers = [(at, i, m) for at, i in enumerate(filled) if i and (m := NUMBER_LINE.match(lines[i])) and i not in headers]
    if not numbers:
        return set()
    held = {i for _, i, _ in numbers}

    def beside(at: int, step: int) -> str:
        """The next line of text in a direction, headers and numbers left aside."""
        at += step
        while 0 <= at < len(filled) and (filled[at] in held or filled[at] in headers):
            at += step
        return lines[filled[at]] if 0 <= at < len(filled) else ""

    traces = None
    found: set[int] = set()
    for k, (at, i, m) in enumerate(numbers):
        value, style = int(m[1]), re.sub(r"\d+", "0", lines[i])
        marked = style != "0"
        plain_text = not _tabular(beside(at, -1)) and not _tabular(beside(at, 1))
        breaks = plain_text and _interrupts(beside(at, -1), beside(at, 1))
        near = any(filled[j] in headers for j in (at - 1, at + 1) if 0 <= j < len(filled))
        # A member of a sequence: one more or less than a neighbour of the same style, a page of text apart.
        steps = [(numbers[j][0], int(numbers[j][2][1]) - value, numbers[j][1]) for j in (k - 1, k + 1) if 0 <= j < len(numbers)]
        chained = any(d == (1 if j > at else -1) and abs(j - at) > 3 and re.sub(r"\d+", "0", lines[o]) == style for j, d, o in steps)
        if breaks or near or (marked and (chained or (at + 1 < len(filled) and plain_text))):
            found.add(i)
            continue
        if plain_text:
            if traces is None:
                traces = any(a and a[-1] in HYPHENS and b[:1].islower() for a, b in zip(lines, lines[1:])) or any(_mixed(t) for line in lines for t in _touching(line.lower()))
            if traces or chained:
                found.add(i)
    return found


def _tabular(line: str) -> bool:
    """A line of a table or account, not of running text: no sentence of words, or a number at its end."""
    return sum(c.isalpha() for c in line) < 0.6 * len(line) or line[-1:].isdigit()


def _touching(low: str) -> Iterator[str]:
    return (_token_at(low, m.start()) for m in TOUCH.finditer(low))


def _lines(text: str) -> list[str]:
    return text.replace("\r\n", "\n").replace("\r", "\n").split("\n")


def header_candidates(text: str) -> list[tuple[int, str, int, bool]]:
    """(line, shape, surroundings, whether it stands at a page edge) of the lines that may be running headers."""
    lines = [s.strip() for s in _lines(text)]
    numbers = None
    out = []
    filled = [i for i, s in enumerate(lines) if s]
    for at, i in enumerate(filled):
        if not at or not (shape := header_shape(lines[i])):
            continue
        if numbers is None:
            numbers = page_numbers(lines)
        before, after = filled[at - 1], filled[at + 1] if at + 1 < len(filled) else None
        edge = before in numbers or after in numbers or bool(EDGE_NUMBER.search(lines[i]))
        if not edge and after is not None:
            edge = _interrupts(lines[before], lines[after]) or (before == i - 1 and after == i + 1 and all(len(lines[j]) >= 1.5 * len(lines[i]) and not _tabular(lines[j]) for j in (before, after)))
        out.append((i, shape, zlib.crc32(f"{lines[before]}\n{lines[after] if after is not None else ''}".encode()), edge))
    return out


def header_lines(base: DataFrame, *, min_pages: int = MIN_PAGES, min_volumes: int = MIN_VOLUMES) -> DataFrame:
    """(key, lines): the running headers of each text of ``base`` (key, volume, text) as line numbers from 0."""

    def candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(key, volume, *c) for key, volume, text in zip(b["key"], b["volume"], b["text"]) for c in header_candidates(text)]
            yield pd.DataFrame(rows, columns=["key", "volume", "line", "shape", "around", "edge"])

    # Only the candidates' shapes: counted and looked up.
    found = checkpointed(base.mapInPandas(candidates, "key string, volume long, line int, shape string, around long, edge boolean"))
    edges = found.where("edge").select("volume", "shape", "around").distinct()
    per_volume = edges.groupBy("volume", "shape").agg(F.count("*").alias("pages"))
    # Per shape and volume first, so that one header of all volumes is no single task's work.
    spread_ = found.groupBy("shape", "volume", "around").agg(F.max("edge").alias("edge")).groupBy("shape", "volume").agg(F.count("*").alias("pages"), F.max("edge").alias("edge"))
    shared = spread_.groupBy("shape").agg(F.sum("pages").alias("pages"), F.count("*").alias("volumes"), F.count_if("edge").alias("edges"))
    shared = shared.where((F.col("pages") >= min_pages) & (F.col("volumes") >= min_volumes) & (F.col("edges") >= 2)).select("shape", F.lit(True).alias("shared"))
    own = per_volume.join(shared, "shape", "left").where((F.col("pages") >= min_pages) | F.col("shared")).select("volume", "shape")
    exact = found.join(own, ["volume", "shape"], "left_semi").select("key", "line").unionAll(found.join(shared.select("shape"), "shape", "left_semi").select("key", "line"))
    # Fuzzy: equal at the beginning or the end, and one edit per ten letters. A semi join, as in ``_misread``.
    ends = lambda df: df.where(F.length("shape") >= 8).withColumn("end", F.explode(F.array(F.concat(F.lit("<"), F.left("shape", F.lit(4))), F.concat(F.lit(">"), F.right("shape", F.lit(4))))))
    headers = ends(own).select(F.col("volume").alias("of"), F.col("end").alias("alike"), F.col("shape").alias("header"))
    apart = F.levenshtein("shape", "header")
    near = ends(found).join(headers, (F.col("volume") == F.col("of")) & (F.col("end") == F.col("alike")) & (apart <= F.greatest(F.lit(1), F.floor(F.length("header") / 10))), "left_semi")
    return exact.unionAll(near.select("key", "line")).groupBy("key").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _one_word(left: str, right: str) -> bool:
    """Whether two parts may be one word: letters of one script."""
    return bool(CYRILLIC.search(left)) or (left.replace("-", "").isalpha() and not CYRILLIC.search(right))


def parse(text: str, headers: set[int]) -> dict:
    """Parts one section's text into its body and the traces of its pages; ``headers``: its lines that are running headers."""
    lines = _lines(text)
    bare = [line.strip() for line in lines]
    numbers = page_numbers(bare, headers)
    pageno = bool(numbers)
    paragraphs: list[list[str]] = []
    last = ""
    breaks: list[tuple[str, str, str]] = []
    gap_blank = gap_cut = False
    for i, (line, s) in enumerate(zip(lines, bare)):
        if not s:
            gap_blank = True
            continue
        if i in numbers or i in headers:
            gap_cut = True
            pageno |= i in headers and bool(EDGE_NUMBER.search(s))
            continue
        # ``last`` is the line before without its ends' white space.
        broken = BREAK.search(last) if last and last[-1] in HYPHENS and s[0].islower() else None
        if not paragraphs:
            paragraphs.append([s])
        elif broken and not ((right := NEXT.match(s)) and _one_word(broken[1], right[1])):
            # A number or numeral with its ending: the hyphen is its own.
            paragraphs[-1].append(s)
        elif broken:
            left = broken[1].lower()
            breaks.append((left + right[1].lower(), f"{left}-{right[1].lower()}", left.rpartition("-")[2]))
            paragraphs[-1][-1] = last[: broken.end(1)]
            paragraphs[-1] += [MARK, s]
        elif (gap_cut and (last[-1] not in ".!?…»”:" or s[0].islower())) or not (gap_blank or (not gap_cut and line.startswith(("  ", "\t")))):
            paragraphs[-1] += [" ", s]
        else:
            paragraphs.append([s])
        last = s
        gap_blank = gap_cut = False
    whole = "\n\n".join("".join(p) for p in paragraphs)
    joined = whole.replace(MARK, "").lower()
    mixed = any(_mixed(t) for t in _touching(joined))
    return {"header": bool(headers), "pageno": pageno, "mixed": mixed, "body": whole, "breaks": breaks, "tokens": list(set(PLAIN.findall(joined))), "compounds": list(set(COMPOUND.findall(whole.lower()))) if "-" in whole else []}


def _token_at(text: str, at: int) -> str:
    start = at
    while start and INSIDE.match(text[start - 1]):
        start -= 1
    return TOKEN.match(text, start).group()


def _mixed(token: str) -> bool:
    """A word with Cyrillic letters and characters of another kind within it."""
    return bool(CYRILLIC.search(token) and (OTHER.search(token) or "/i" in token)) and not re.fullmatch(r"\d+[а-яё]{1,3}|[а-яё]{1,3}\d+|[а-яё]+(?:/[а-яё]+)+", token)


def unmix(token: str) -> str:
    """The Cyrillic word meant by a word of mixed characters."""
    low = token.lower()
    for a, b in GROUPS:
        low = low.replace(a, b)
    low = low.translate(str.maketrans(_FROM, _TO)).replace("і", "i") if not re.search("[іїєґ]", token.lower()) else low
    return low.upper() if len(token) > 1 and token.isupper() else low.capitalize() if token[:1].isupper() else low


def _prepare(df: DataFrame, id_col: str, text_col: str, volume_col: str | None, limits: dict, *keep: str) -> DataFrame:
    """The parsed texts, with ``keep`` of text and body; written once, as they are read for the vocabulary,
    the breaks, the misread words and the repair."""
    volume = F.xxhash64(col(volume_col)) if volume_col else F.lit(0).cast("long")
    base = spread(df.select(col(id_col).alias("id"), col(text_col).alias("text"), volume.alias("volume"))).where("text is not null and text <> ''")
    # Rows of one id and text are alike in everything but their volume.
    base = base.withColumn("key", F.md5(F.concat_ws("\u0001", F.col("id").cast("string"), F.col("volume").cast("string"), "text")))
    headers = header_lines(base.select("key", "volume", "text"), **limits)

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [parse(t, frozenset(n) if n is not None else frozenset()) for t, n in zip(b["text"], b["lines"])]
            out = pd.DataFrame(rows, columns=["header", "pageno", "mixed", "body", "breaks", "tokens", "compounds"])
            yield out.assign(id=b["id"].to_numpy(), key=b["key"].to_numpy(), text=b["text"].to_numpy(), breaks=[[{"joined": j, "hyphenated": h, "prefix": p} for j, h, p in r["breaks"]] for r in rows])[names]

    kind = base.schema["id"].dataType.simpleString()
    fields = {"id": kind, "key": "string", "header": "boolean", "pageno": "boolean", "mixed": "boolean", "breaks": "array<struct<joined:string,hyphenated:string,prefix:string>>", "tokens": "array<string>", "compounds": "array<string>"} | dict.fromkeys(keep, "string")
    names = list(fields)
    joined = base.select("id", "key", "text").join(headers, "key", "left")
    return checkpointed(joined.mapInPandas(parsed, ", ".join(f"{n} {t}" for n, t in fields.items())))


def _vocabulary(parsed: DataFrame) -> DataFrame:
    return parsed.select(F.explode("tokens").alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def _breaks(parsed: DataFrame) -> DataFrame:
    """(id, key, at, own): for each broken word whether the hyphen is its own."""
    compounds = parsed.select(F.explode("compounds").alias("hyphenated")).groupBy("hyphenated").agg(F.count("*").alias("h"))
    prefixes = compounds.groupBy(F.substring_index("hyphenated", "-", 1).alias("prefix")).agg(F.sum("h").alias("p"))
    rows = parsed.select("id", "key", F.posexplode("breaks").alias("at", "b")).select("id", "key", "at", "b.*")
    asked = rows.select(F.col("joined").alias("word")).distinct()
    known = _vocabulary(parsed).join(asked, "word", "left_semi").select(F.col("word").alias("joined"), F.col("n").alias("j"))
    j, h, p = (F.coalesce(c, F.lit(0)) for c in ("j", "h", "p"))
    own = ((h > 0) & (h >= j)) | ((h == 0) & (j <= 1) & (p >= 3))
    return rows.join(known, "joined", "left").join(compounds, "hyphenated", "left").join(prefixes, "prefix", "left").select("id", "key", "at", own.alias("own"))


def skeleton(word):
    """A word's shape: confusable letters read as one."""
    return F.translate(word, "".join(g[1:] for g in CONFUSED), "".join(g[0] * (len(g) - 1) for g in CONFUSED))


def misread_words(parsed: DataFrame, *, ratio: float = 6.0, known_from: int = 4) -> DataFrame:
    """(word, meant): rare words of the shape of a word at least ``ratio`` times as frequent."""
    words = _vocabulary(parsed).where((F.length("word") >= 5) & F.col("word").rlike("^[а-яё]+$")).withColumn("shape", skeleton(F.col("word")))
    good = words.where(F.col("n") >= known_from).select("shape", F.col("word").alias("meant"), F.col("n").alias("known"))
    swapped = F.forall(F.zip_with(F.split("word", ""), F.split("meant", ""), lambda a, b: (a == b) | F.concat(a, b).isin([*PAIRS, *(p[::-1] for p in PAIRS)])), lambda x: x)
    apart = F.size(F.filter(F.zip_with(F.split("word", ""), F.split("meant", ""), lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: x["a"] != x["b"]))
    pairs = words.join(good, "shape").where((F.col("word") != F.col("meant")) & (F.col("known") >= F.col("n") * ratio)).where(apart <= F.greatest(F.lit(2), F.floor(F.length("word") / 4))).where(swapped)
    return pairs.groupBy("word").agg(F.max(F.struct("known", "meant")).alias("m")).select("word", F.col("m.meant").alias("meant"))


def _misread(parsed: DataFrame, wrong: DataFrame, of: str) -> DataFrame:
    """(``of``, word): the misread words of every text.

    The exploded words are far larger than Spark takes them for, which knows the size of the file but not the
    lengths of its arrays; the left side of a semi join is never broadcast, whatever its size is taken for.
    """
    return parsed.select(of, F.explode("tokens").alias("word")).join(wrong, "word", "left_semi").select(of, "word")


def scan_noise(df: DataFrame, id_col: str, text_col: str, volume_col: str | None = None, **limits) -> DataFrame:
    """(id, noise): the kinds of noise of every text: hyphen, misread, header, pageno; distinct.

    ``volume_col`` names the volume (or run of sections) within which running headers repeat; null
    volumes are one, and without the column all texts are one.
    Null and empty texts have none; null ids stay null; repeated rows only weigh in the
    vocabulary as often as they come. An empty table
    gives an empty result. Other columns of ``df`` are never read.
    """
    parsed = _prepare(df, id_col, text_col, volume_col, limits)
    flags = parsed.select("id", F.explode(F.array_compact(F.array(F.when(F.col("header"), "header"), F.when(F.col("pageno"), "pageno"), F.when(F.col("mixed"), "misread")))).alias("noise"))
    hyphens = _breaks(parsed).where("not own").select("id", F.lit("hyphen").alias("noise"))
    wrong = _misread(parsed, misread_words(parsed), "id").select("id", F.lit("misread").alias("noise"))
    return flags.unionAll(hyphens).unionAll(wrong).distinct()


def repaired(df: DataFrame, id_col: str, text_col: str, volume_col: str | None = None, **limits) -> DataFrame:
    """(id, text, repaired, changed): every row with its repaired text; repeated rows stay.

    A text without noise comes out as it is. Else running headers and page numbers are gone, the
    lines of a paragraph are joined, broken words are whole, and misread words are corrected.
    Null and empty texts come out as they are.
    """
    parsed = _prepare(df, id_col, text_col, volume_col, limits, "text", "body")
    own = _breaks(parsed).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("at", "own"))).alias("own"))
    words = misread_words(parsed)
    wrong = _misread(parsed, words, "key").join(words, "word").groupBy("key").agg(F.map_from_entries(F.collect_set(F.struct("word", "meant"))).alias("meant"))
    rows = parsed.join(own, "key", "left").join(wrong, "key", "left")
    rows = rows.select("id", "text", "header", "pageno", "mixed", "body", F.transform("own", lambda o: o["own"]).alias("own"), F.map_keys("meant").alias("bad"), F.map_values("meant").alias("good"))

    def fix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                own_ = list(r.own) if r.own is not None else []
                bad = dict(zip(r.bad, r.good)) if r.bad is not None else {}
                if not (r.header or r.pageno or r.mixed or bad or any(not o for o in own_)):
                    out.append(r.text)
                    continue
                parts = r.body.split(MARK)
                text = parts[0] + "".join(("-" if o else "") + p for o, p in zip([*own_, *[False] * len(parts)], parts[1:]))

                def right(m: re.Match) -> str:
                    w = m.group()
                    if w.lower() in bad:
                        g = bad[w.lower()]
                        return g.capitalize() if w[0].isupper() else g
                    return unmix(w) if _mixed(w.lower()) else w

                out.append(TOKEN.sub(right, text))
            yield pd.DataFrame({"id": b["id"], "text": b["text"], "repaired": out, "changed": [a != t for a, t in zip(out, b["text"])]})

    kind = rows.schema["id"].dataType.simpleString()
    done = rows.mapInPandas(fix, f"id {kind}, text string, repaired string, changed boolean")
    rest = df.select(col(id_col).alias("id"), col(text_col).alias("text")).where("text is null or text = ''")
    return done.unionAll(rest.select("id", "text", F.col("text").alias("repaired"), F.lit(False).alias("changed")))
