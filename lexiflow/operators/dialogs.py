"""Conversation rows, prompts and pluggable models."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|start_header_id|>"), role, F.lit("<|end_header_id|>\n\n"), text, F.lit("<|eot_id|>\n"))


def chat_text(system: str, user: Column, answer: Column | None = None) -> Column:
    """A conversation in chat format; without an answer it ends open for the assistant."""
    end = F.lit("<|start_header_id|>assistant<|end_header_id|>\n\n") if answer is None else turn(F.lit("assistant"), answer)
    return F.concat(F.lit("<|begin_of_text|>"), turn(F.lit("system"), F.lit(system)), turn(F.lit("user"), user), end)


def chatml_text(turns: list[tuple[str, Column]]) -> Column:
    """The turns in the ChatML format."""
    return F.concat(*[F.concat(F.lit(f"<|im_start|>{role}\n"), text, F.lit("<|im_end|>\n")) for role, text in turns])


def conversation(system: str, user: Column, answer: Column) -> Column:
    """array<struct<role, content>> of three turns."""
    return F.array(*[F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in (("system", F.lit(system)), ("user", user), ("assistant", answer))])


def news_prompt(title: Column, content: Column, limit: int = 500) -> Column:
    return F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.left(F.coalesce(content, F.lit("")), F.lit(limit)))


def pick(options: list[str], key: Column, seed: int = 0) -> Column:
    """A seeded pick from a list by key: the same on every run."""
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(F.xxhash64(F.lit(seed), key), F.lit(len(options))) + 1).cast("int"))


def content_of(columns: list[str], title: str = "title", content: str = "content", combined: str = "input") -> Column:
    """Content from whichever field has it: content, else the text part of ``input``, else text, article or body."""
    choice: list[Column] = []
    if content in columns:
        choice.append(F.nullif(F.trim(content), F.lit("")))
    if combined in columns:
        choice += [F.nullif(F.regexp_extract(combined, r"^Заголовок: (.+?)\nТекст: (.+)", 2), F.lit("")), F.nullif(F.trim(combined), F.lit(""))]
    choice += [F.nullif(F.trim(c), F.lit("")) for c in ("text", "article", "body") if c in columns]
    return F.coalesce(*choice) if choice else F.lit(None).cast("string")


def keyword_hits(text: Column, keywords: Column) -> Column:
    return F.size(F.filter(keywords, lambda k: F.contains(F.lower(text), F.lower(k))))


def apply_model(df: DataFrame, input_col: str, output_col: str, model: Callable[[], Callable[[list[str]], list[str]]], retries: int = 3) -> DataFrame:
    """``output_col`` and ``error`` from a batch model that is made once per task; a batch that keeps failing becomes rows with an error."""
    schema = df.withColumn(output_col, F.lit(None).cast("string")).withColumn("error", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = model()
        for b in batches:
            error = None
            for _ in range(retries):
                try:
                    out, error = call(["" if t is None else t for t in b[input_col]]), None
                    break
                except Exception as e:  # noqa: BLE001  (any failure of the model is data)
                    out, error = [None] * len(b), str(e)
            yield b.assign(**{output_col: out, "error": error})

    return df.mapInPandas(run, schema)
