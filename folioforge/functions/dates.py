"""Dates in running text.

A text is read as a row of numbers and words with what stands between them. Three
neighbours are a date if their kinds fit one of the ``SHAPES`` and the marks between
them are those of the shape.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioforge.functions.text import fold_text

#: The first three letters of German and English months, in order.
MONTHS = {name: 1 + i for i, names in enumerate("jan jae|feb|mar mae mrz|apr|mai may|jun|jul|aug|sep|okt oct|nov|dez dec".split("|")) for name in names.split()}
#: Endings of ordinal numbers, and words that may stand inside a date.
ENDINGS, FILLERS = frozenset("st nd rd th ter ten".split()), frozenset(["of"])
#: What the three parts are, and the marks that may stand between them. ``exact``: one mark, which spaces may surround.
SHAPES = (("day month year", "./-", True), ("month day year", "./-", True), ("year month day", "./-", True), ("day name year", " .,", False), ("name day year", " .,-", False))
PART = re.compile(r"(\d+)|([^\W\d_]+)")


def _parts(text: str) -> Iterator[tuple[str, str]]:
    """``(what stood before, number or word)``; endings and fillers belong to what stands before the next part."""
    at, before, after_number = 0, "", False
    for m in PART.finditer(text):
        before += text[at : m.start()]
        at = m.end()
        word = (m[2] or "").lower()
        if (after_number and not before and word in ENDINGS) or word in FILLERS:
            after_number = False
            continue
        yield before, m[0]
        before, after_number = "", m[1] is not None


def _values(role: str, part: str) -> list[int]:
    """The numbers that a part can be in a role."""
    if role == "name":
        month = MONTHS.get(fold_text(part)[:3]) if len(part) >= 3 else None
        return [month] if month else []
    if not part.isascii() or not part.isdigit():
        return []
    if role == "year":
        return [int(part)] if len(part) == 4 else [2000 + int(part), 1900 + int(part)] if len(part) == 2 else []
    return [int(part)] if len(part) <= 2 else []


def _fits(between: str, marks: str, exact: bool) -> bool:
    inner = between.strip() if exact else between
    return len(inner) == 1 and inner in marks if exact else all(c in marks or c.isspace() for c in inner)


def _days(text: str) -> Iterator[datetime.date]:
    row = list(_parts(text))
    for (_, a), (x, b), (y, c) in zip(row, row[1:], row[2:]):
        for roles, marks, exact in SHAPES:
            if not (_fits(x, marks, exact) and _fits(y, marks, exact)):
                continue
            names = roles.split()
            if exact and names[0] == "year" and len(a) != 4:
                continue
            for first in _values(names[0], a):
                for second in _values(names[1], b):
                    for third in _values(names[2], c):
                        own = dict(zip(names, (first, second, third), strict=True))
                        try:
                            yield datetime.date(own["year"], own.get("month") or own["name"], own["day"])
                        except ValueError:
                            continue


def _joined(text: str) -> str:
    """Letter-spaced stretches as words: single characters that single spaces separate."""
    out: list[str] = []
    single = False
    for word in text.split(" "):
        if single and len(word) == 1 and word.isalnum():
            out[-1] += word
        else:
            out.append(word)
            single = len(word) == 1 and word.isalnum()
    return " ".join(out)


def dates_of(text: str) -> list[str]:
    """All dates as ISO text, sorted, every reading of an ambiguous one; letter-spaced text counts, too."""
    return sorted({day.isoformat() for form in {text, _joined(text)} for day in _days(form)})


@F.pandas_udf(T.ArrayType(T.StringType()))
def dates_in(text: pd.Series) -> pd.Series:
    return text.map(dates_of, na_action="ignore")
