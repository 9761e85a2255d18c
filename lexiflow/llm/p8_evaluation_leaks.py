"""Evaluation texts inside a corpus, by a generalised suffix automaton.

The automaton holds every run of words of every item. A document's words are streamed through it;
after each word the state gives the longest run ending there that some item also has. Runs of
``min_run`` words or more mark the item's words they cover, and a document holds an item if the
marked part reaches ``min_cover``. The same pass gives the spans of the document to be removed.

Items are the bounded, stated set here: they are taken in blocks of at most ``block_words`` words,
one automaton per block, each broadcast on its own. Its size is bounded with the block: some two states a
word, most of them with one follower, which takes twelve bytes in arrays; only branching states have a
dictionary. The result is the same for any block size.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import WORD, col, spread, words, words_of

MIN_RUN, MIN_COVER, BLOCK_WORDS = 8, 0.4, 200_000


class SuffixAutomaton:
    """Over the words of several items; parted by starting each item at the root again.

    End positions are kept for states that hold runs of ``least`` words or more.
    """

    def __init__(self, items: list[tuple[object, list[str]]], least: int = 1):
        self.vocabulary: dict[str, int] = {}
        self.ids = [i for i, _ in items]
        self.sizes = [len(w) for _, w in items]
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[list[tuple[int, int]]] = [[]]
        for number, (_, item) in enumerate(items):
            last = 0
            for at, word in enumerate(item):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)), own)
                own[last].append((number, at))
        for state in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[state] > 0:
                own[self.link[state]].extend(own[state])
        self.ends = {state: tuple(set(x)) for state, (x, n) in enumerate(zip(own, self.length)) if x and n >= least}
        # States with one follower, nearly all, in arrays; the others in dictionaries.
        self.only, self.goto = array("i", [-1]) * len(self.next), array("i", [-1]) * len(self.next)
        self.many: dict[int, dict[int, int]] = {}
        for state, follow in enumerate(self.next):
            if len(follow) == 1:
                ((self.only[state], self.goto[state]),) = follow.items()
            elif follow:
                self.many[state] = follow
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def _state(self, length: int, own: list) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        own.append([])
        return len(self.length) - 1

    def _split(self, p: int, c: int, own: list) -> int:
        q = self.next[p][c]
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, own)
        self.next[clone], self.link[clone] = dict(self.next[q]), self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int, own: list) -> int:
        if c in self.next[last]:
            return self._split(last, c, own)
        new, p = self._state(self.length[last] + 1, own), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, c, own)
        return new

    def runs(self, tokens: list[str], least: int) -> Iterator[tuple[int, int, int]]:
        """(place of the run's last word, its length, state), for every word that ends a run of ``least`` or more."""
        only, goto, many, link, length, none, state, n = self.only, self.goto, self.many, self.link, self.length, {}, 0, 0
        for at, c in enumerate(map(self.vocabulary.get, tokens)):
            if c is None:
                state = n = 0
                continue
            while (to := goto[state] if only[state] == c else many.get(state, none).get(c)) is None and state:
                state = link[state]
                n = length[state]
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                yield at, n, state

    def covered(self, tokens: list[str], least: int) -> tuple[dict[int, set[int]], list[tuple[int, int]]]:
        """The marked words of each item, and the runs of the document as (first, last) words, joined where they touch."""
        marks: dict[int, set[int]] = {}
        spans: list[tuple[int, int]] = []
        for at, n, state in self.runs(tokens, least):
            first = at - n + 1
            while spans and first <= spans[-1][1] + 1:
                first = min(first, spans.pop()[0])
            spans.append((first, at))
            while state > 0 and n >= least:
                for item, end in self.ends.get(state, ()):
                    marks.setdefault(item, set()).update(range(end - n + 1, end + 1))
                state = self.link[state]
                n = self.length[state]
        return marks, spans


def _item_blocks(items: DataFrame, id_col: str, text_col: str, block_words: int) -> list[DataFrame]:
    rows = items.select(col(id_col).alias("item_id"), col(text_col).alias("text")).where("item_id is not null and text is not null").distinct()
    total = rows.agg(F.sum(F.size(words_of("text")))).first()[0] or 0
    n = max(1, math.ceil(total / block_words))
    return [rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k) for k in range(n)]


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, *, min_run: int = MIN_RUN, min_cover: float = MIN_COVER, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, cover, longest_run): documents that hold an item, whole or in good part.

    ``cover`` is the part of the item's words, as a sequence, that lie in runs of at least
    ``min_run`` words that the document also has; ``longest_run`` is the longest such run.
    Null ids and texts, empty texts and items shorter than ``min_run`` words match nothing. Repeated
    rows give one row; items of equal text are all reported. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    base = spread(docs.select(col(doc_id).alias("doc_id"), col(doc_text).alias("text"))).where("doc_id is not null and text is not null")
    id_type, item_type = (f.schema[0].dataType.simpleString() for f in (base.select("doc_id"), items.select(col(item_id))))
    schema = f"doc_id {id_type}, item_id {item_type}, cover double, longest_run int"
    parts = []
    for block in _item_blocks(items, item_id, item_text, block_words):
        automaton = SuffixAutomaton([(r["item_id"], w) for r in block.orderBy("item_id").toLocalIterator() if len(w := words(r["text"])) >= min_run], min_run)
        shared = spark.sparkContext.broadcast(automaton)

        def match(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            a = shared.value
            for b in batches:
                out = []
                for key, text in zip(b["doc_id"], b["text"]):
                    marks, _ = a.covered(words(text), min_run)
                    for item, places in marks.items():
                        if len(places) >= min_cover * a.sizes[item] - 1e-9:
                            run = longest = 0
                            for p in sorted(places):
                                run = run + 1 if p - 1 in places else 1
                                longest = max(longest, run)
                            out.append((key, a.ids[item], len(places) / a.sizes[item], longest))
                yield pd.DataFrame(out, columns=["doc_id", "item_id", "cover", "longest_run"])

        parts.append(base.mapInPandas(match, schema))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionAll(p)
    return found.distinct()


def without_leaks(docs: DataFrame, items: DataFrame, doc_id: str, doc_text: str, item_id: str, item_text: str, *, min_run: int = MIN_RUN, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, text, removed_words): every row with its spans of ``min_run`` or more item words cut out.

    The spans of all item blocks are found in the text as it is, united, and cut at once, so the
    block size changes nothing. Null and untouched texts come out as they are with 0 removed words.
    """
    spark = docs.sparkSession
    base = spread(docs.select(col(doc_id).alias("doc_id"), col(doc_text).alias("text")))
    kind = base.schema["doc_id"].dataType.simpleString()
    out = base.withColumn("spans", F.array().cast("array<int>"))
    for block in _item_blocks(items, item_id, item_text, block_words):
        shared = spark.sparkContext.broadcast(SuffixAutomaton([(r["item_id"], w) for r in block.orderBy("item_id").toLocalIterator() if len(w := words(r["text"])) >= min_run], min_run))

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for b in batches:
                spans = [[*before, *(p for span in shared.value.covered([m.group().lower().replace("ё", "е") for m in WORD.finditer(text)], min_run)[1] for p in span)] if isinstance(text, str) else [] for text, before in zip(b["text"], b["spans"])]
                yield pd.DataFrame({"doc_id": b["doc_id"], "text": b["text"], "spans": spans})

        out = out.mapInPandas(look, f"doc_id {kind}, text string, spans array<int>")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, removed = [], []
            for text, flat in zip(b["text"], b["spans"]):
                n = 0
                if len(flat):
                    places = [m.span() for m in WORD.finditer(text)]
                    for first, last in reversed(_united(zip(flat[::2], flat[1::2]))):
                        text = text[: places[first][0]] + text[places[last][1] :]
                        n += last - first + 1
                texts.append(text if isinstance(text, str) else None)
                removed.append(n)
            yield pd.DataFrame({"doc_id": b["doc_id"], "text": texts, "removed_words": removed})

    return out.mapInPandas(cut, f"doc_id {kind}, text string, removed_words int")


def _united(spans) -> list[list[int]]:
    """Spans (first, last) in order, those that touch or overlap as one."""
    out: list[list[int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1][1] = max(out[-1][1], last)
        else:
            out.append([first, last])
    return out
