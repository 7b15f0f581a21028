"""Cleaning of raw articles, and marking of mentions in texts."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions.columns import contains_any, sentence_case


def without_blacklisted(df: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Rows of which no named column contains one of its words, in any case; nulls stay."""
    for c, ws in words.items():
        df = df.where(~F.coalesce(contains_any(c, ws), F.lit(False)))
    return df


def lead_snippet(title: Column, content: Column, any_case: bool = True) -> Column:
    """The title as a sentence, and the content unless the title holds it already."""
    head = F.concat(sentence_case(title), F.when(F.endswith(title, F.lit(".")), " ").otherwise(". "))
    inside = F.contains(F.lower(head), F.lower(content)) if any_case else F.contains(head, content)
    return F.when(inside, head).otherwise(F.concat(head, F.coalesce(content, F.lit(""))))


def trimmed_body(content: Column, first: int = 1, last: int = 7, dateline: str = " - ") -> Column:
    """The body without its first and last lines, and without what precedes the first dateline mark in the line that is then first; null if nothing is left."""
    lines = F.split(content, "\n")
    n = F.size(lines) - first - last
    kept = F.when(n > 0, F.slice(lines, first + 1, F.greatest(n, F.lit(1))))
    at = F.instr(kept[0], dateline)
    head = F.when(at > 0, F.substr(kept[0], at + len(dateline))).otherwise(F.lit(""))
    return F.array_join(F.concat(F.array(head), F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(1)))), "\n")


def plain_title(title: Column) -> Column:
    """The title without a prefix in capitals before a dash, and without what follows ' - '."""
    t = F.trim(title)
    head = F.substring_index(t, "-", 1)
    t = F.when(F.contains(t, F.lit("-")) & (head == F.upper(head)), F.trim(F.substr(t, F.instr(t, "-") + 1))).otherwise(t)
    return F.substring_index(t, " - ", 1)


def snippet(title: Column, text: Column, least: int = 100, most: int = 500) -> Column:
    """The title as a sentence and sentences of the text until least characters are reached; null if longer than most, or without a title. The last sentence of the text isn't taken, as it may be cut."""

    @F.pandas_udf(StringType())
    def build(titles: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for t, x in zip(titles, texts):
            if not t:
                out.append(None)
                continue
            made = t if t.endswith(".") else f"{t}. "
            for s in (x or "").replace("\n", " ").split(". ")[:-1]:
                if len(made) >= least:
                    break
                s = s.strip()
                if s and s not in made:
                    made += s + (" " if s.endswith(".") else ". ")
            out.append(made if len(made) <= most else None)
        return pd.Series(out, dtype=object)

    return build(title, text)


def lemma_text(text: Column | str, tokens: Column | str) -> Column:
    """The text with each token's characters replaced by its lemma; tokens: array<struct<start,end,lemma>> that don't overlap."""
    text, tokens = (F.col(c) if isinstance(c, str) else c for c in (text, tokens))
    ordered = F.array_sort(tokens, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    start = F.struct(F.lit("").alias("done"), F.lit(0).alias("at"))

    def put(s: Column, t: Column) -> Column:
        between = F.substr(text, s["at"] + 1, t["start"] - s["at"])
        return F.struct(F.concat(s["done"], between, t["lemma"]).alias("done"), t["end"].cast("int").alias("at"))

    return F.aggregate(ordered, start, put, lambda s: F.concat(s["done"], F.substr(text, s["at"] + 1, F.char_length(text) + 1)))


def marked_html(text: Column, mentions: Column) -> Column:
    """The text as HTML with <mark data-entity=...> around the mentions (array<struct<start,end,entity>>); overlapping later ones are left out."""

    @F.pandas_udf(StringType())
    def mark(texts: pd.Series, all_mentions: pd.Series) -> pd.Series:
        out = []
        for t, ms in zip(texts, all_mentions):
            if t is None:
                out.append(None)
                continue
            parts, at = [], 0
            for m in sorted(ms if ms is not None else [], key=lambda m: (m["start"], m["end"])):
                if m["start"] >= at:
                    parts += [html.escape(t[at : m["start"]]), f'<mark data-entity="{html.escape(m["entity"] or "")}">', html.escape(t[m["start"] : m["end"]]), "</mark>"]
                    at = m["end"]
            out.append("".join(parts) + html.escape(t[at:]))
        return pd.Series(out, dtype=object)

    return mark(text, mentions)


def scored_by(df: DataFrame, text: str, scorer, out: str = "sentiment") -> DataFrame:
    """Rows whose score is null scored by a function from a pandas Series of texts to one of numbers, in Arrow batches; the rest stay."""
    rows = df.where(F.col(out).isNull())
    score = F.pandas_udf(scorer, "double")
    return rows.withColumn(out, score(F.col(text))).unionByName(df.where(F.col(out).isNotNull()))


def lexicon_scorer(words: dict[str, float]):
    """Mean weight of the words of a text that the lexicon has; 0 without one."""

    def score(texts: pd.Series) -> pd.Series:
        def one(t):
            hits = [words[w] for w in (t or "").lower().split() if w in words]
            return sum(hits) / len(hits) if hits else 0.0

        return texts.map(one).astype(float)

    return score
