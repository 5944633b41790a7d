"""Date phrases of a search ("seit 2023", "last quarter", "März bis Mai 2025") as ranges.

A query becomes a row of codes, one for each word that can belong to a phrase; the
phrases are shapes of codes, so German and English share them. All of it is built-in
expressions: a table of searches is read in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioforge.functions.text import fold

#: Month names, folded, in order.
MONTH_NAMES = (
    "januar jan jaenner january|februar feb february|maerz marz maer mrz march mar|april apr|mai may|juni jun june|juli jul july|august aug|"
    "september sept sep|oktober okt october oct|november nov|dezember dez december dec"
).split("|")
#: The words of phrases by what they mean. S since, B until, V before, A after, Z between, U and; R0 this, R1 last, R2 the one before; U_ units; J "in the year".
WORDS = {
    "S": "seit ab since", "B": "bis until till through to", "V": "vor before", "A": "nach after", "Z": "zwischen between", "U": "und and",
    "R0": "diese diesen diesem dieser dieses aktuelle aktuellen aktuellem aktueller aktuelles this current",
    "R1": "letzte letzten letztem letzter letztes vorige vorigen vorigem voriger voriges vergangene vergangenen vergangenem vergangener vergangenes last previous past",
    "R2": "vorletzte vorletzten vorletztem vorletzter vorletztes",
    "Ud": "tag tage tagen day days", "Uw": "woche wochen week weeks", "Um": "monat monate monaten month months", "Uq": "quartal quarter", "Uy": "jahr jahre jahren year years",
    "J": "jahrgang", "": "im in den die the from of von vom aus over",
}
FIRST, LAST = "1900-01-01", "2100-12-31"
_Y, _M = r"Y(\d{4}) ", r"M(\d\d) "
#: Shapes of codes, the longer before the shorter where both can start at a place.
SHAPES = {
    "month_span": rf"(?:(?:Z )?{_M}(?:{_Y})?B |Z {_M}(?:{_Y})?U ){_M}{_Y}",
    "month": rf"([SBVA] )?{_M}{_Y}",
    "span": rf"(?:(?:Z )?{_Y}B |Z {_Y}U ){_Y}",
    "last_n": r"R1 N(\d{1,3}) U([dwmy]) ",
    "relative": r"R([012]) U([wmqy]) ",
    "bound": rf"([SBVA]) {_Y}",
    "year": rf"(?:J |Uy ){_Y}",
}
_ANY = "|".join(f"(?:{shape})" for shape in SHAPES.values())


def codes(query: Column) -> Column:
    """The query as codes with a space after each; quoted parts and other words are ``x``."""
    by_word = {w: code for code, words in WORDS.items() for w in words.split()} | {w: f"M{i + 1:02d}" for i, names in enumerate(MONTH_NAMES) for w in names.split()}
    known = F.create_map(*[F.lit(x) for pair in by_word.items() for x in pair])
    parts = F.regexp_extract_all(fold(F.regexp_replace(query, r'"[^"]*"', " qq ")), F.lit(r"([a-z]+|[0-9]+|[–-])"))

    def code(w: Column) -> Column:
        year = F.when(w.rlike("^(19|20)[0-9]{2}$"), F.concat(F.lit("Y"), w))
        number = F.when(w.rlike("^[0-9]{1,3}$"), F.concat(F.lit("N"), w))
        return F.coalesce(year, number, F.when(w.isin("-", "–"), "B"), F.try_element_at(known, w), F.lit("x"))

    return F.array_join(F.transform(F.filter(F.transform(parts, code), lambda c: c != ""), lambda c: F.concat(c, F.lit(" "))), "")


def date_range(query: Column, today: Column) -> Column:
    """``(date_from, date_to, kind)`` of a query's first phrase, ISO and inclusive; null without one."""
    return F.element_at(F.transform(F.array(F.regexp_extract(codes(query), _ANY, 0)), lambda hit: _range(hit, today)), 1)


def _range(hit: Column, today: Column) -> Column:
    def group(kind: str, i: int) -> Column:
        return F.regexp_extract(hit, f"^{SHAPES[kind]}$", i)

    def number(text: Column) -> Column:
        return text.try_cast("int")

    def day(y: Column, m: Column | int, d: int = 1) -> Column:
        return F.make_date(y, m if isinstance(m, Column) else F.lit(m), F.lit(d))

    def struct(lo: Column, hi: Column, kind: str) -> Column:
        both = F.struct(F.date_format(lo, "yyyy-MM-dd").alias("date_from"), F.date_format(hi, "yyyy-MM-dd").alias("date_to"), F.lit(kind).alias("kind"))
        return F.when(hit.rlike(f"^{SHAPES[kind]}$") & (lo <= hi), both)

    ever, always = F.lit(FIRST).cast("date"), F.lit(LAST).cast("date")

    def bounded(prep: Column, lo: Column, hi: Column, kind: str) -> Column:
        start = F.when(prep.startswith("S"), lo).when(prep.startswith("B") | prep.startswith("V"), ever).when(prep.startswith("A"), F.date_add(hi, 1)).otherwise(lo)
        stop = F.when(prep.startswith("S"), today).when(prep.startswith("V"), F.date_sub(lo, 1)).when(prep.startswith("A"), always).otherwise(hi)
        return struct(start, stop, kind)

    either = lambda kind, *places: number(F.concat(*[group(kind, i) for i in places]))
    m1, m2, y2 = either("month_span", 1, 3), number(group("month_span", 5)), number(group("month_span", 6))
    y1 = F.coalesce(either("month_span", 2, 4), F.when(m1 <= m2, y2).otherwise(y2 - 1))
    month = day(number(group("month", 3)), number(group("month", 2)))
    a, b = either("span", 1, 2), number(group("span", 3))
    n, back = number(group("last_n", 1)), number(group("relative", 1))
    unit, step = group("relative", 2), group("last_n", 2)
    ago = F.when(step == "d", F.date_sub(today, n)).when(step == "w", F.date_sub(today, 7 * n)).when(step == "m", F.add_months(today, -n)).otherwise(F.add_months(today, -12 * n))
    size = F.when(unit == "y", 12).when(unit == "q", 3).otherwise(1)
    of_unit = F.when(unit == "y", F.trunc(today, "year")).when(unit == "q", F.trunc(today, "quarter")).otherwise(F.trunc(today, "month"))
    since = F.when(unit == "w", F.date_sub(F.trunc(today, "week"), 7 * back)).otherwise(F.add_months(of_unit, -size * back))
    until = F.when(unit == "w", F.date_add(since, 6)).otherwise(F.date_sub(F.add_months(since, size), 1))
    bound, year = number(group("bound", 2)), number(group("year", 1))
    return F.coalesce(
        struct(day(y1, m1), F.last_day(day(y2, m2)), "month_span"),
        bounded(group("month", 1), month, F.last_day(month), "month"),
        struct(day(F.least(a, b), 1), day(F.greatest(a, b), 12, 31), "span"),
        struct(F.when((n >= 1) & (n <= 100), ago), today, "last_n"),
        struct(since, until, "relative"),
        bounded(group("bound", 1), day(bound, 1), day(bound, 12, 31), "bound"),
        struct(day(year, 1), day(year, 12, 31), "year"),
    )


def partial_range(value: Column) -> Column:
    """``(date_from, date_to)`` of ``2024``, ``2024-05``, ``2024-05-17`` or ``A..B`` with either side open; null for other text."""

    def of(side: Column) -> Column:
        size, good = F.size(F.split(side, "-")), side.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$")
        first = F.when(good, F.concat(side, F.when(size == 1, "-01-01").when(size == 2, "-01").otherwise("")).try_cast("date"))
        last = F.when(size == 1, F.date_sub(F.add_months(first, 12), 1)).when(size == 2, F.last_day(first)).otherwise(first)
        return F.struct(F.date_format(first, "yyyy-MM-dd").alias("lo"), F.date_format(last, "yyyy-MM-dd").alias("hi"))

    at = F.instr(value, "..")
    left, right = F.when(at > 0, F.substr(value, F.lit(1), at - 1)).otherwise(value), F.when(at > 0, F.substr(value, at + 2)).otherwise(value)
    lo = F.when((at > 0) & (left == ""), "0000-01-01").otherwise(of(left)["lo"])
    hi = F.when((at > 0) & (right == ""), "9999-12-31").otherwise(of(right)["hi"])
    return F.when(lo.isNotNull() & hi.isNotNull(), F.struct(lo.alias("date_from"), hi.alias("date_to")))
