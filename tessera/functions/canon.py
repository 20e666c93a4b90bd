"""Canonical JSON, digests, seals, JSON pointers and memory sizes."""

from __future__ import annotations

import hashlib
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def canonical(value) -> str:
    """JSON with sorted keys, without spaces, as UTF-8 text; NaN and infinities are errors."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def digest(value) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def seal(value: dict, key: str = "sha256") -> dict:
    """The object with the digest of all its other members under `key`."""
    body = {k: v for k, v in value.items() if k != key}
    return {**body, key: digest(body)}


def seal_errors(value: dict, key: str = "sha256") -> list[str]:
    return [] if seal(value, key) == value else [f"{key}_mismatch" if key in value else f"{key}_missing"]


def strict_json(text: str) -> dict:
    """Parse a JSON object; duplicate keys and non-finite numbers are errors."""

    def pairs(items):
        out = dict(items)
        if len(out) != len(items):
            raise ValueError("duplicate_key")
        return out

    def constant(name):
        raise ValueError(f"non_finite_number:{name}")

    value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    if not isinstance(value, dict):
        raise ValueError("root_must_be_object")
    return value


@F.pandas_udf(T.StringType())
def canonical_json(s: pd.Series) -> pd.Series:
    """Canonical form of JSON text; null where it isn't strict JSON."""

    def one(x):
        try:
            return canonical(strict_json(x))
        except (ValueError, TypeError):
            return None

    return s.map(one)


def _json(c: Column) -> Column:
    return F.coalesce(F.to_json(F.struct(c.alias("v"))), F.lit("{}"))


def row_canonical(columns: dict[str, Column]) -> Column:
    """Canonical JSON of named text and integer columns, keys sorted, nulls kept; in the JVM."""
    parts = [F.lit("{")]
    for i, k in enumerate(sorted(columns)):
        member = F.coalesce(F.regexp_extract(_json(columns[k]), r"^\{\"v\":(.*)\}$", 1), F.lit(""))
        parts += [F.lit(("," if i else "") + json.dumps(k) + ":"), F.when(columns[k].isNull(), "null").otherwise(member)]
    return F.concat(*parts, F.lit("}"))


def row_digest(columns: dict[str, Column]) -> Column:
    return F.sha2(row_canonical(columns), 256)


def pointer_escape(key: Column) -> Column:
    return F.replace(F.replace(key, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1"))


def pointer_path(pointer: Column) -> Column:
    """JSONPath of a JSON pointer: escapes undone, canonical array indexes as such."""
    parts = F.filter(F.split(pointer, "/"), lambda p: p != "")
    step = lambda p: F.when(p.rlike("^(0|[1-9][0-9]*)$"), F.concat(F.lit("["), p, F.lit("]"))).otherwise(F.concat(F.lit("['"), F.replace(F.replace(p, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")), F.lit("']")))
    return F.concat(F.lit("$"), F.array_join(F.transform(parts, step), ""))


def memory_bytes(c: Column) -> Column:
    """Bytes of a size such as `141 GB` or `64 GiB`; null for other text."""
    number = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(GiB|MiB|GB|MB)\s*$", 1)
    unit = F.regexp_extract(c, r"^\s*([0-9]+(?:\.[0-9]+)?)\s*(GiB|MiB|GB|MB)\s*$", 2)
    factor = F.when(unit == "GiB", 2**30).when(unit == "MiB", 2**20).when(unit == "GB", 10**9).when(unit == "MB", 10**6)
    return F.round(F.nullif(number, F.lit("")).cast("double") * factor).cast("long")
