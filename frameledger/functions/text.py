"""Text helpers: untrusted JSON, templates, message lists."""
from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: What a template variable and a fenced value look like.
VARIABLE = re.compile(r"\{\{\s*([A-Za-z_]\w*)\s*\}\}", re.A)
_FENCE = re.compile(r"```(?:json)?\s*(\{.*?\}|\[.*?\])\s*```", re.S)


def recover_json(text: str):
    """The JSON value in untrusted text: the whole text, else the first fenced object or list (which then
    must parse), else the longest parsable stretch from the first bracket on. Raises ValueError."""
    body = text.strip()
    if not body:
        raise ValueError("empty text")
    try:
        return json.loads(body)
    except ValueError:
        pass
    fenced = _FENCE.search(body)
    if fenced:
        return json.loads(fenced[1])
    opens = [p for p in (body.find("{"), body.find("[")) if p >= 0]
    if not opens:
        raise ValueError("no object or list in the text")
    # a decoder that stops where the first value ends finds the longest stretch in one pass
    try:
        value, stop = json.JSONDecoder().raw_decode(body, min(opens))
    except (ValueError, RecursionError) as e:
        raise ValueError("no parsable stretch") from e
    return value


def _canonical(v) -> str:
    """Strict JSON; non-finite numbers as tagged texts, so that a strict reader accepts it."""

    def tag(x):
        if isinstance(x, float) and x != x:
            return "NaN"
        if isinstance(x, float) and x in (float("inf"), float("-inf")):
            return "Infinity" if x > 0 else "-Infinity"
        if isinstance(x, dict):
            return {k: tag(y) for k, y in x.items()}
        if isinstance(x, list):
            return [tag(y) for y in x]
        return x

    return json.dumps(tag(v), ensure_ascii=False)


@F.pandas_udf(StructType([StructField("value", StringType()), StructField("error", StringType())]))
def extract_json(text: pd.Series) -> pd.DataFrame:
    """Canonical JSON of the recovered value, or the error. Null stays null in both."""
    out = []
    for t in text:
        if t is None:
            out.append((None, None))
            continue
        try:
            out.append((_canonical(recover_json(t)), None))
        except (ValueError, RecursionError) as e:
            out.append((None, str(e)))
    return pd.DataFrame(out, columns=["value", "error"])


def render(template: str, variables: dict[str, Column]) -> Column:
    """The template with its variables filled in one pass (a value that looks like a variable stays as it
    is), trimmed. A variable that is not given is an error; a null value makes the text null."""
    missing = sorted(set(VARIABLE.findall(template)) - set(variables))
    if missing:
        raise ValueError(f"missing variables: {', '.join(missing)}")
    parts: list[Column] = []
    at = 0
    for m in VARIABLE.finditer(template):
        parts += [F.lit(template[at : m.start()]), variables[m[1]].cast("string")]
        at = m.end()
    parts.append(F.lit(template[at:]))
    return F.regexp_replace(F.concat(*parts), r"^\s+|\s+$", "")


def check_template(template: str, allowed: set[str]) -> None:
    if not template.strip():
        raise ValueError("empty template")
    unknown = sorted(set(VARIABLE.findall(template)) - allowed)
    if unknown:
        raise ValueError(f"variables not allowed: {', '.join(unknown)}")


def index_range(frames: Column) -> Column:
    return F.when(F.size(frames) > 0, F.concat(F.lit("0.."), (F.size(frames) - 1).cast("string")))


def interval_text(i: Column) -> Column:
    return F.concat(F.lit("["), i["start"].cast("string"), F.lit(", "), i["end"].cast("string"), F.lit("]"))


@F.pandas_udf(StringType())
def rate_text(rate: pd.Series) -> pd.Series:
    """Three decimals without trailing zeros, rounded as Python rounds; empty for null."""
    return rate.map(lambda v: "" if pd.isna(v) else f"{v:.3f}".rstrip("0").rstrip("."))


def labels_json(objects: Column) -> Column:
    """The labels of the objects as a JSON list, ``[]`` for none."""
    return F.coalesce(F.to_json(F.transform(objects, lambda o: F.trim(o["label"]))), F.lit("[]"))


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def chat(*turns: Column) -> Column:
    return F.array(*turns)
