"""Business records in JSON as plain sentences.

The depth of such a record has no bound, so this is the one place where JSON
is walked in Python: a pandas UDF over the raw text, which keeps the order of
keys and the spelling of numbers. The sentences' wording is fixed values: texts
have to be the same for the same keys and graphs.
"""

from __future__ import annotations

import json
from typing import Any

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def scalar_text(value: Any) -> str:
    if value is None:
        return "null (unknown)"
    return {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def facts(path: str, value: Any) -> list[tuple[str, str]]:
    """(path, value) of every scalar: keys joined by dots, list positions in brackets."""
    found, todo = [], [(path, value)]
    while todo:
        at, now = todo.pop()
        if isinstance(now, dict):
            todo += reversed([(f"{at}.{k}", v) for k, v in now.items()])
        elif isinstance(now, list):
            todo += reversed([(f"{at}[{i}]", v) for i, v in enumerate(now)])
        else:
            found.append((at, scalar_text(now)))
    return found


def business_sentences(raw: str | None, reviews: bool = True) -> str | None:
    """One sentence for each fact, then the reviews under a header of their own."""
    record = json.loads(raw) if raw else None
    if not isinstance(record, dict):
        return None
    name = str(record.get("name") or "").strip() or "The business"
    sentences = []
    for key, value in record.items():
        if key == "name":
            sentences.append(f"The business is named {name}.")
        elif key != "review_info":
            sentences += [f"{name} has {path} = {text}." for path, text in facts(key, value)]
    said = record.get("review_info")
    texts = [str(r["review_text"]).strip() for r in said if isinstance(r, dict) and r.get("review_text") is not None] if isinstance(said, list) else []
    body = "\n".join(sentences)
    return body + "\n\nCustomer reviews:\n" + "\n".join(texts) if reviews and texts else body


def business_text(raw: Column, reviews: bool = True) -> Column:
    """``business_sentences`` of a column; null where it is no JSON object."""

    @F.pandas_udf("string")
    def convert(column: pd.Series) -> pd.Series:
        return column.map(lambda x: business_sentences(x, reviews), na_action="ignore")

    return convert(raw)


def flat_facts(raw: Column) -> Column:
    """Facts of a JSON object as strings ``path = value``, in order."""

    @F.pandas_udf("array<string>")
    def convert(column: pd.Series) -> pd.Series:
        return column.map(lambda x: [f"{p.lstrip('.')} = {v}" for p, v in facts("", json.loads(x))], na_action="ignore")

    return convert(raw)
