r"""Splitting long texts at natural boundaries with an overlap, by one bounded-quantifier regex.

The alternatives of the regex are ordered by the strength of the boundary: up to ``limit - overlap``
characters ending at a blank line, else at a sentence end, else at a line break, else at white
space, else that many characters. Each greedy alternative takes as much as it can. The matches are
the new parts of the pieces; offsets looked back from them supply the overlap. All of it runs as SQL
array functions in the JVM.

A sentence end is ``.``, ``!``, ``?`` or an ellipsis, with closing quotes or brackets, before white
space; a full stop after a single letter or a usual abbreviation is none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import col, spread

LIMIT, OVERLAP = 2000, 200

#: Abbreviations whose full stop ends no sentence, beside single letters.
ABBREVIATIONS = (
    "стр с см др пр тыс млн млрд трлн руб коп кн гл т г гг в вв ст п пп рис табл прим ред изд изд-во сб вып ч "
    "ср напр им тов гр ул пер пл обл губ уезд волость сел дер мин сек ч кв кг км см мм экз акад проф доц инж "
    "abs art bd bzw ca cf ch co dr ed eds eg etc fig hrsg ibid ie inc jr ltd mr mrs ms no nr op p pp prof s sr st tab u usw vgl vol vs z"
).split()

CLOSERS = "»”“’\"')\\]}›"
BLANK_LINE = r"\n[ \t\r\f]*\n"


def sentence_end() -> str:
    """Regex of the marks that end a sentence where white space or the end of the text follows."""
    letters = "|".join(sorted({a for a in ABBREVIATIONS if len(a) > 1 and a.isalpha()}, key=lambda a: (-len(a), a)))
    no_stop = rf"(?<!(?<![\p{{L}}\p{{N}}])(?:\p{{L}}|{letters}))"
    return rf"(?:[!?…]|{no_stop}\.)[{CLOSERS}]{{0,4}}"


def piece_regex(room: int) -> str:
    """Up to ``room`` characters by the strongest boundary in reach.

    A blank line in the last half of the room is preferred to a later sentence end; an earlier
    blank line is one more boundary beside the sentence ends.
    """
    half, blank, end = room // 2, rf"(?={BLANK_LINE})", rf"(?=\s|\z)(?<={sentence_end()})"
    return (
        r"(?isu)\G(?:"
        rf".{{1,{room}}}\z"
        rf"|.{{{half},{room}}}{blank}"
        rf"|.{{1,{room}}}(?:{blank}|{end})"
        rf"|.{{{half},{room}}}(?=\n)"
        rf"|.{{{half},{room}}}(?=\s)"
        rf"|.{{{room}}})"
    )


def new_parts(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<string> whose members joined give the text back; none is longer than ``limit - overlap``."""
    return F.regexp_extract_all(text, F.lit(piece_regex(limit - overlap)), F.lit(0))


def ends_naturally(part: Column, following: Column) -> Column:
    """Whether a part ends at a blank line or a sentence end; ``following`` is the next part."""
    return following.rlike("^" + BLANK_LINE) | (F.right(part, F.lit(24)).rlike(rf"(?iu){sentence_end()}\z") & following.rlike(r"^\s"))


def split_pieces(df: DataFrame, id_col: str, text_col: str, *, limit: int = LIMIT, overlap: int = OVERLAP, only_longer: bool = False) -> DataFrame:
    """(id, piece_no, piece, new_chars, forced): the pieces of every text.

    No piece is longer than ``limit`` characters. Each piece but the first starts with the last
    ``overlap`` characters before its ``new_chars`` new ones; the new parts joined give the text.
    A piece ends at a blank line or a sentence end wherever there is one in reach; ``forced`` tells
    that there was none, so that it was cut at a line break, white space or mere characters.

    A text of at most ``limit - overlap`` characters is one piece; ``only_longer`` leaves out texts
    of at most ``limit``. Null and empty texts give no piece, a null id stays null, repeated rows
    give repeated pieces. Other columns of ``df`` are never read.

    Two neighbouring parts are never both shorter than half the room: a short part means that no
    later boundary was in reach, and then the next part is cut beyond half. So the two parts before
    always hold the overlap.
    """
    room = limit - overlap
    if not 0 <= overlap <= room // 2 or room < 64:
        raise ValueError("the overlap may be half of what is left of the limit at most")
    base = spread(df.select(col(id_col).alias("id"), col(text_col).alias("text"))).where(F.length("text") > (limit if only_longer else 0))
    parts = base.select("id", new_parts(F.col("text"), limit, overlap).alias("parts"))

    def piece(part: Column, i: Column) -> Column:
        before = F.concat(F.coalesce(F.get("parts", i - 2), F.lit("")), F.coalesce(F.get("parts", i - 1), F.lit("")))
        following = F.get("parts", i + 1)
        return F.struct(F.concat(F.right(before, F.lit(overlap)), part).alias("piece"), F.length(part).alias("new_chars"), F.coalesce(~ends_naturally(part, following), F.lit(False)).alias("forced"))

    return parts.select("id", F.posexplode(F.transform("parts", piece)).alias("piece_no", "p")).select("id", "piece_no", "p.*")


def forced_items(df: DataFrame, id_col: str, text_col: str, *, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id): the ids with a text that had to be cut where there is no natural boundary; distinct."""
    return split_pieces(df, id_col, text_col, limit=limit, overlap=overlap, only_longer=True).where("forced").select("id").distinct()
