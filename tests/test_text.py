from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from folioforge.functions import dates as DT
from folioforge.functions import phrases as P
from folioforge.functions import text as X
from folioforge.sources.html import html_text


def test_fold_builtin_equals_exact_on_the_corpus(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert docs.where(X.fold(F.col("text")) != X.fold_exact("text")).count() == 0


@pytest.mark.parametrize(
    ("text", "folded"),
    [("Müller", "mueller"), ("STRASSE Straße", "strasse strasse"), ("Café", "cafe"), ("ﬁn", "fin"), ("", "")],
)
def test_fold_text(text, folded):
    assert X.fold_text(text) == folded


@pytest.mark.parametrize(
    ("value", "number"),
    [("1.234,56", 1234.56), ("1234,56", 1234.56), ("1.234", 1234.0), ("12.5", 12.5), ("1,234.56", 1234.56), ("12 €", 12.0), ("EUR 7", 7.0), ("-3,5", -3.5), ("abc", None), ("", None), ("1 234,5", 1234.5), ("1.234.567", 1234567.0), ("1234.567", 1234.567), ("$1,234,567.80", 1234567.8), ("1,2,3", None), ("12..5", None), (".5", 0.5), ("+1e3", 1000.0)],
)
def test_parse_number(spark, value, number):
    assert spark.createDataFrame([(value,)], "v string").select(X.parse_number(F.col("v"))).first()[0] == number


@pytest.mark.parametrize(
    ("a", "b", "edits"),
    [("sommertag", "somrnertag", 1), ("lampe", "lmape", 1), ("garten", "garten", 0), ("abc", "xyz", 3), ("clara", "dara", 1), ("winter", "vvintre", 2)],
)
def test_spelling_distance(a, b, edits):
    assert X.spelling_distance(a, b, 2) == edits


def test_word_forms(spark):
    words = {"rechnungen": ["rechnungen", "rechnung"], "vertraege": ["vertraege", "vertraeg", "vertrag"], "haus": ["haus"]}
    for word, forms in words.items():
        assert spark.createDataFrame([(word,)], "w string").select(X.word_forms(F.col("w"))).first()[0] == forms


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    ("text", "day"),
    [
        ("Kontostand per 03.04.2021 und Stand: 5.6.2021", "2021-04-03"),
        ("As of: 1.2.2020, as at 9.2.2020.", "2020-02-09"),
        ("Zeitraum 01.01.2020 bis 31.03.2020, Stichtag 1.5.2020", "2020-03-31"),
        ("vom 1.1.2020 30.1.2020", None),
        ("per 01.01.2031", None),
        ("per 99.99.2020 Stand 7.8.2019", "2019-08-07"),
        ("ein Stand am See, 4.5.2020", None),
        ("", None),
        (None, None),
    ],
)
def test_as_of(spark, text, day):
    assert one(spark, text, lambda c: X.as_of(c, F.lit("2030-12-31"))) == day


@pytest.mark.parametrize(
    ("text", "number", "amount"),
    [
        ("Invoice Number: A-17/3. Amount due $ 1,200.50", "A-17/3", 1200.5),
        ("invoice number unknown, amount due later; Amount due: 7,25 EUR", None, 7.25),
        ("Number 5", None, None),
        (None, None, None),
    ],
)
def test_values_after_cues(spark, text, number, amount):
    assert one(spark, text, lambda c: X.field_after(c, "invoice number")) == number
    assert one(spark, text, lambda c: X.amount_after(c, "amount due")) == amount


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("Amount due due 5", "5"),
        ("invoice number: invoice number 7", "7"),
        ("amount\n due:; EUR 9.", "9"),
        ("xamount 5", None),
        ("amount due EUR", None),
        ("form 7 8", "7"),
        ("form A 8", None),
        ("due date 4", "4"),
        ("amount due date 6", "6"),
        (" due 3", "3"),
        ("tota\u017f 3", None),
    ],
)
def test_cues_that_overlap(spark, text, value):
    assert one(spark, text, lambda c: X.field_after(c, "due", "amount due", "due date", "invoice number", "form", "form 7", "totas")) == value


def test_only_words_after_a_cue_are_looked_at(spark):
    """Before, every word of a text went through the cue's comparison."""
    plan = spark.range(1).select(X.amount_after(F.lit("a b").substr(F.lit(1), F.col("id").cast("int") + 9), "amount due"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "transform(split(substr" not in plan


@pytest.mark.parametrize(
    ("subject", "forwarded", "bare"),
    [("RE: fwd :Plan: Mai", True, "Plan: Mai"), ("Plan", False, "Plan"), ("Aw:re: Re", False, "Re"), ("Fw:", True, ""), ("Note: Re: x", False, "Note: Re: x"), ("", False, "")],
)
def test_subjects(spark, subject, forwarded, bare):
    got = one(spark, subject, X.subject_parts)
    assert (got["forwarded"], got["subject"]) == (forwarded, bare)


@pytest.mark.parametrize(
    ("title", "usual"),
    [("Bericht 2.Quartal/1999 Werk", "Bericht Q2 1999 Werk"), ("iv. quartal 2003", "Q4 2003"), ("Plan q2-2011", "Plan Q2 2011"), ("Plan 2011/Q1", "Plan Q1 2011"), ("2001: Ernte", "Ernte 2001"), ("2001 Ernte 2002", "2001 Ernte 2002"), ("  Haus  am See , ", "Haus am See"), ("2001", "2001"), ("- ", None), ("5. Quartal 2003", "5. Quartal 2003")],
)
def test_titles(title, usual):
    assert X.usual_title(title) == usual


def test_spelling_distance_against_a_table():
    """Random words of few letters against the textbook recurrence."""
    import random

    rng = random.Random(5)
    pairs = [*X.CONFUSED, *[(y, x) for x, y in X.CONFUSED]]
    for _ in range(1500):
        a, b = ("".join(rng.choices("rnmcldvwa", k=rng.randint(0, 6))) for _ in "ab")
        best = {}
        for i in range(len(a) + 1):
            for j in range(len(b) + 1):
                ways = [0] if i == j == 0 else []
                ways += [best[i - 1, j] + 1] if i else []
                ways += [best[i, j - 1] + 1] if j else []
                ways += [best[i - 1, j - 1] + (a[i - 1] != b[j - 1])] if i and j else []
                ways += [best[i - 2, j - 2] + 1] if i > 1 and j > 1 and a[i - 2 : i] == b[j - 2 : j][::-1] else []
                ways += [best[i - len(x), j - len(y)] + 1 for x, y in pairs if a[:i].endswith(x) and b[:j].endswith(y)]
                best[i, j] = min(ways)
        assert X.spelling_distance(a, b, 2) == min(best[len(a), len(b)], 3), (a, b)


@pytest.mark.parametrize(
    ("text", "day"),
    [("31.12.2025", "2025-12-31"), ("31/12/25", "2025-12-31"), ("2025-12-31", "2025-12-31"), ("31. Dezember 2025", "2025-12-31"), ("December 31st, 2025", "2025-12-31"), ("2 4 M a i 1 9 9 8", "1998-05-24")],
)
def test_dates_of(text, day):
    assert day in DT.dates_of(text)


def test_no_dates():
    assert DT.dates_of("99.99.9999 nothing") == []


def test_hidden_elements():
    assert html_text("<div hidden><div>a</div>secret</div>shown") == "shown"
    assert html_text("a<wbr hidden>b") == "ab"
    assert html_text("<div style='display:none'><p>x<br>y</div><table><tr><td>1</td><td>2</td></tr></table>") == "1 2"


def test_html_text():
    page = "<html><head><title>x</title><style>p{}</style></head><body><p>One&nbsp;two</p><div hidden>gone</div><div style='display: none'>gone</div><ul><li>a</li><li>b</li></ul><script>1</script></body></html>"
    assert html_text(page) == "One two\na\nb"
    assert html_text("") == ""


@pytest.mark.parametrize(
    ("query", "lo", "hi"),
    [
        ("Quittung April bis Juli 2023", "2023-04-01", "2023-07-31"),
        ("von Okt. 2022 bis Jan. 2023", "2022-10-01", "2023-01-31"),
        ("zwischen Mai und Juni 2021", "2021-05-01", "2021-06-30"),
        ("Dezember bis März 2022", "2021-12-01", "2022-03-31"),
        ("since March 2024 invoice", "2024-03-01", "2025-08-14"),
        ("bis Mai 2024", "1900-01-01", "2024-05-31"),
        ("nach Februar 2024", "2024-03-01", "2100-12-31"),
        ("2021 bis 2019", "2019-01-01", "2021-12-31"),
        ("2021 und 2023", None, None),
        ("zwischen 2021 und 2023", "2021-01-01", "2023-12-31"),
        ("letztes Quartal", "2025-04-01", "2025-06-30"),
        ("this week", "2025-08-11", "2025-08-17"),
        ("vorletzten Monat", "2025-06-01", "2025-06-30"),
        ("in den letzten 3 Monaten", "2025-05-14", "2025-08-14"),
        ("last 10 days", "2025-08-04", "2025-08-14"),
        ("seit 2023", "2023-01-01", "2025-08-14"),
        ("before 2020", "1900-01-01", "2019-12-31"),
        ("im Jahr 2022", "2022-01-01", "2022-12-31"),
        ('"seit 2023" Vertrag', None, None),
        ("Vertrag 2023", None, None),
    ],
)
def test_date_phrases(spark, query, lo, hi):
    row = spark.createDataFrame([(query,)], "q string").select(P.date_range(F.col("q"), F.lit("2025-08-14").cast("date")).alias("r")).first()["r"]
    assert (row and (row["date_from"], row["date_to"])) == (lo and (lo, hi))


@pytest.mark.parametrize(
    ("value", "want"),
    [("2024", ("2024-01-01", "2024-12-31")), ("2024-02", ("2024-02-01", "2024-02-29")), ("2024-02-30", None), ("2023..2024-02", ("2023-01-01", "2024-02-29")), ("..2020", ("0000-01-01", "2020-12-31")), ("2020-05-01..", ("2020-05-01", "9999-12-31")), ("x", None)],
)
def test_partial_ranges(spark, value, want):
    row = spark.createDataFrame([(value,)], "v string").select(P.partial_range(F.col("v")).alias("r")).first()["r"]
    assert (row and tuple(row)) == want
