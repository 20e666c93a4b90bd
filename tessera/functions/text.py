"""Addressable text: segments, quotes, spans, fragments, similarity, surfaces, response parsing."""

from __future__ import annotations

import difflib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

SEGMENT, LOWER = 240, 120


def segments(text: str) -> list[tuple[int, int]]:
    """Spans of at most SEGMENT code points that cover the text: cut after a late line break, else a late space."""
    out, at = [], 0
    while at < len(text):
        end = min(at + SEGMENT, len(text))
        if end < len(text):
            cut = text.rfind("\n", at + LOWER, end)
            if cut < 0:
                cut = next((i for i in range(end - 1, at + LOWER - 1, -1) if text[i].isspace()), -1)
            end = cut + 1 if cut >= 0 else end
        out.append((at, end))
        at = end
    return out


def windows(df: DataFrame, key: str, text: str) -> DataFrame:
    """Windows of each unit: key, window (from 0), start, end, text."""
    schema = df.select(key).schema.add("window", "integer").add("start", "integer").add("end", "integer").add("text", "string")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            rows = [(k, i, a, b, t[a:b]) for k, t in zip(p[key], p[text], strict=True) if t for i, (a, b) in enumerate(segments(t))]
            yield pd.DataFrame(rows, columns=[f.name for f in schema])

    return df.select(key, text).mapInPandas(run, schema)


def quote_options(text: Column) -> Column:
    """Distinct non-blank quotes of a text in order: itself, trimmed, and each of its lines and cells, raw and trimmed."""
    space = "^\\s+|\\s+$"
    strip = lambda c: F.regexp_replace(c, space, "")
    parts = F.flatten(F.transform(F.split(text, "[\n\t]"), lambda p: F.array(p, strip(p))))
    return F.array_distinct(F.filter(F.concat(F.array(text, strip(text)), parts), lambda p: strip(p) != ""))


def occurrences(text: Column, quote: Column) -> Column:
    """Starts (from 0) of all occurrences of a quote, overlaps included."""
    places = F.when(F.length(text) >= F.length(quote), F.sequence(F.lit(1), F.length(text) - F.length(quote) + 1)).otherwise(F.array().cast("array<int>"))
    found = F.transform(F.filter(places, lambda i: F.substring(text, i, F.length(quote)) == quote), lambda i: i - 1)
    return F.when(F.instr(text, quote) == 0, F.array().cast("array<int>")).otherwise(found)


def quote_status(units: DataFrame, quotes: DataFrame) -> DataFrame:
    """Resolve quotes(quote_id, unit_id, quote) in units(unit_id, text): status, start, end.

    unit_not_found, unit_not_unique, quote_not_found, ambiguous (several places) or resolved.
    """
    known = units.groupBy("unit_id").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    j = quotes.join(known, "unit_id", "left").withColumn("one", F.instr("text", F.col("quote")))
    # two searches tell none, one and several apart
    j = j.withColumn("two", F.when(F.col("one") > 0, F.call_function("locate", F.col("quote"), F.col("text"), F.col("one") + 1)))
    status = F.when(F.col("copies").isNull(), "unit_not_found").when(F.col("copies") > 1, "unit_not_unique").when(F.col("one") == 0, "quote_not_found").when(F.col("two") > 0, "ambiguous").otherwise("resolved")
    first = F.when(status == "resolved", F.col("one") - 1)
    return j.select("quote_id", "unit_id", status.alias("status"), first.alias("start"), (first + F.length("quote")).alias("end"))


def reading_spans(df: DataFrame, group: str, order: str, text: str, gap: int = 2) -> DataFrame:
    """Span of each text when a group's texts are joined in order with `gap` characters between them."""
    w = Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + gap).over(w), F.lit(0))
    return df.select(group, order, start.alias("char_start"), (start + F.length(text)).alias("char_end"))


def collapse(text: str) -> tuple[str, list[int]]:
    """White space collapsed to one space and trimmed, and the source offset of each kept character."""
    out, at = [], []
    for m in re.finditer(r"\S+|\s+", text):
        if not m.group().isspace():
            out.append(m.group())
            at += range(m.start(), m.end())
        elif out:
            out.append(" ")
            at.append(m.start())
    joined = "".join(out)
    return (joined[:-1], at[:-1]) if joined.endswith(" ") else (joined, at)


def surface_span(text: str, surface: str, n: int = 1) -> tuple[int, int] | None:
    """Raw offsets of the n-th (overlapping) occurrence of a surface when white space is dropped on both sides."""
    kept = [i for i, c in enumerate(text) if not c.isspace()]
    bare, want = "".join(text[i] for i in kept), "".join(surface.split())
    at = -1
    for _ in range(n):
        at = bare.find(want, at + 1) if want else -1
        if at < 0:
            return None
    return kept[at], kept[at + len(want) - 1] + 1


def uncovered(tokens: list[str], covers: list[list[str]]) -> list[list[str]]:
    """Runs of tokens that no cover explains, each cover used once at its first free place."""
    free = [True] * len(tokens)
    for c in covers:
        for i in range(len(tokens) - len(c) + 1 if c else 0):
            if tokens[i : i + len(c)] == c and all(free[i : i + len(c)]):
                free[i : i + len(c)] = [False] * len(c)
                break
    out: list[list[str]] = []
    for i, t in enumerate(tokens):
        if free[i]:
            if i and free[i - 1]:
                out[-1].append(t)
            else:
                out.append([t])
    return out


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks of two texts, to 6 places."""
    return pd.Series([None if x is None or y is None else round(difflib.SequenceMatcher(None, x, y).ratio(), 6) for x, y in zip(a, b, strict=True)])


def parse_response(text: str, bare_only: bool = False) -> dict:
    """The JSON object of a response: bare, or alone in one code fence."""
    from .canon import strict_json

    t = text.strip()
    m = re.fullmatch(r"```(?:json)?\s*\n(.*?)\n?```", t, re.S)
    if m and bare_only:
        raise ValueError("fenced_response")
    return strict_json(m.group(1) if m else t)


def channels(text: str) -> list[tuple[str, int, int]]:
    """Channel spans of `<|channel|>name<|message|>body<|end|>` texts: name and body's code-point span."""
    return [(m.group(1).strip(), m.start(2), m.end(2)) for m in re.finditer(r"<\|channel\|>([^<]*)<\|message\|>(.*?)(?:<\|end\|>|<\|return\|>|\Z)", text, re.S)]


def render(template: str, values: dict[str, str]) -> str:
    """Fill {{MARKERS}}; each must occur exactly once and all must be given."""
    marks = re.findall(r"\{\{([A-Z0-9_]+)\}\}", template)
    if sorted(marks) != sorted(values):
        raise ValueError("markers_must_occur_exactly_once")
    return re.sub(r"\{\{([A-Z0-9_]+)\}\}", lambda m: values[m.group(1)], template)


def dictionary_encode(df: DataFrame, key: str, text: str, least: int = 20) -> tuple[DataFrame, DataFrame]:
    """Texts of at least `least` characters that repeat are stored once: (rows with ref or text, dictionary)."""
    again = df.filter(F.length(text) >= least).groupBy(text).agg(F.count("*").alias("n"), F.min(key).alias("first")).filter("n > 1")
    entries = again.select(F.col("first").alias("ref"), F.col(text))
    rows = df.join(entries, text, "left").select(key, F.when(F.col("ref").isNull(), F.col(text)).alias(text), "ref")
    return rows, entries


def dictionary_decode(rows: DataFrame, entries: DataFrame, key: str, text: str) -> DataFrame:
    e = entries.select("ref", F.col(text).alias("_stored"))
    return rows.join(e, "ref", "left").select(key, F.coalesce(F.col(text), F.col("_stored")).alias(text))
