"""German stems of folded words, by staged built-in expressions.

The rules are those of the published Snowball algorithm for German in its variant that
reads ``ae oe ue`` as umlauts, so folded words have the stems of the words as written.
A word's regions are measured once; each stage finds the longest ending of its list,
and then drops it if it lies within its region and its condition holds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Vowels, and the letters that may stand before the endings ``s``, ``st`` and ``et``.
VOWELS, BEFORE_S, BEFORE_ST, BEFORE_ET = "aeiouyäöü", "bdfghklmnrt", "bdfghklmnt", "dfghklmnrstUzä"
#: The endings of the three stages.
FIRST = ("e", "em", "en", "erin", "erinnen", "er", "ern", "es", "ln", "lns", "s")
SECOND = ("en", "er", "est", "et", "st")
THIRD = ("end", "heit", "ig", "ik", "isch", "keit", "lich", "ung")
#: What keeps an ``em`` and an ``et``.
KEEPS_EM, KEEPS_ET = "syst", ("geordn", "intern", "plan", "tick", "tr")


def longest(endings: tuple[str, ...]) -> str:
    """A pattern of the longest of some endings, at the end of a word."""
    return f"({'|'.join(sorted(endings, key=len, reverse=True))})$"


def _without(word: Column, ending: Column | str) -> Column:
    n = F.length(ending) if isinstance(ending, Column) else F.lit(len(ending))
    return F.substr(word, F.lit(1), F.length(word) - n)


def _dropped(df: DataFrame, then: str, ok: Column) -> DataFrame:
    """``then`` taken off the end of ``w`` where it stands there and ``ok`` holds; ``ok`` speaks of ``rest``, the word without it."""
    has = F.col("w").endswith(then)
    rest = df.withColumn("rest", F.when(has, _without(F.col("w"), then)))
    return rest.withColumn("w", F.when(has & ok, F.col("rest")).otherwise(F.col("w")))


def with_stem(words: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """``words`` and the stem of its column ``word``: null for null, other characters than a-z as they are.

    Write the result before filtering by the stem: a filter would move below the stages,
    and its condition would grow by each of them.
    """
    # One column for all that the words bring along, so that no name of theirs meets those of the stages.
    row = F.struct(*[F.col(c) for c in words.columns]).alias("row")
    vowel, other = f"[{VOWELS}]", f"[^{VOWELS}]"
    w = F.regexp_replace(F.regexp_replace(F.col(word), "ß", "ss"), f"({vowel})u({vowel})", "$1U$2")
    w = F.regexp_replace(w, f"({vowel})y({vowel})", "$1Y$2")
    w = F.replace(F.replace(w, F.lit("ae"), F.lit("ä")), F.lit("oe"), F.lit("ö"))
    df = words.select(row, F.regexp_replace(w, "(?<!q)ue", "ü").alias("w"))
    region = lambda n: F.length(F.regexp_extract("w", f"^(?:{other}*{vowel}+{other}){{{n}}}", 0))
    whole = F.length("w")
    r1, r2 = region(1), region(2)
    df = df.withColumn("r1", F.when(r1 > 0, F.greatest(r1, F.lit(3))).otherwise(whole)).withColumn("r2", F.when(r2 > 0, r2).otherwise(whole))

    def stage(df: DataFrame, endings: tuple[str, ...], region: str) -> DataFrame:
        found = df.withColumn("ending", F.regexp_extract("w", longest(endings), 1)).withColumn("rest", _without(F.col("w"), F.col("ending")))
        # The region decides for the longest ending only; a shorter one has no turn.
        return found.withColumn("ending", F.when(F.length("rest") >= F.col(region), F.col("ending")).otherwise(""))

    end, rest = F.col("ending"), F.col("rest")
    df = stage(df, FIRST, "r1")
    nis = F.when(rest.endswith("niss"), _without(rest, "s")).otherwise(rest)
    first = (
        F.when(end == "em", F.when(~rest.endswith(KEEPS_EM), rest))
        .when(end.isin("ern", "er"), rest)
        .when(end.isin("e", "en", "es"), nis)
        .when(end == "s", F.when(rest.rlike(f"[{BEFORE_S}]$"), rest))
        .when(end.isin("erin", "erinnen"), F.concat(rest, F.lit("er")))
        .when(end.isin("ln", "lns"), F.concat(rest, F.lit("l")))
    )
    df = stage(df.withColumn("w", F.coalesce(first, "w")), SECOND, "r1")
    kept_et = rest.rlike(f"({'|'.join(KEEPS_ET)})$") | ~rest.rlike(f"[{BEFORE_ET}]$")
    second = F.when(end.isin("en", "er", "est"), rest).when(end == "st", F.when(rest.rlike(f"...[{BEFORE_ST}]$"), rest)).when(end == "et", F.when(~kept_et, rest))
    df = stage(df.withColumn("w", F.coalesce(second, "w")), THIRD, "r2")
    third = F.when(end.isin("end", "ung", "lich", "heit", "keit"), rest).when(end.isin("ig", "ik", "isch"), F.when(~rest.endswith("e"), rest))
    df = df.withColumn("w", F.coalesce(third, "w")).withColumn("last", end)
    # What a dropped ending of the third stage lets go with it.
    in_r = lambda r: F.length("rest") >= F.col(r)
    df = _dropped(df, "ig", F.col("last").isin("end", "ung") & in_r("r2") & ~F.col("rest").endswith("e"))
    softer = df.withColumn("w0", F.col("w"))
    for ending in ("er", "en"):
        same = F.col("w") == F.col("w0")
        softer = _dropped(softer, ending, F.col("last").isin("lich", "heit") & in_r("r1") & same)
    for ending in ("lich", "ig"):
        same = F.col("w") == F.col("w0")
        softer = _dropped(softer, ending, (F.col("last") == "keit") & in_r("r2") & same)
    return softer.select("row.*", F.translate("w", "UYäöü", "uyaou").alias(name))


def stem_sql(source: str, word: str) -> str:
    """Common table expressions that end in ``stems(word, stem)``, for the distinct values of a column: the same rules as one statement a stage."""
    vowel, other = f"[{VOWELS}]", f"[^{VOWELS}]"
    cut = lambda n: f"left(w, length(w) - {n})"
    return f"""st0 AS (SELECT DISTINCT {word} AS word, regexp_replace(regexp_replace(replace({word}, 'ß', 'ss'), '({vowel})u({vowel})', '\\1U\\2', 'g'), '({vowel})y({vowel})', '\\1Y\\2', 'g') AS w FROM {source}),
    st1 AS (SELECT word, replace(replace(replace(replace(replace(w, 'ae', 'ä'), 'oe', 'ö'), 'que', 'q#e'), 'ue', 'ü'), 'q#e', 'que') AS w FROM st0),
    st2 AS (SELECT *, CASE WHEN regexp_matches(w, '^{other}*{vowel}+{other}') THEN greatest(3, length(regexp_extract(w, '^{other}*{vowel}+{other}'))) ELSE length(w) END AS r1,
        CASE WHEN regexp_matches(w, '^{other}*{vowel}+{other}+{vowel}+{other}') THEN length(regexp_extract(w, '^{other}*{vowel}+{other}+{vowel}+{other}')) ELSE length(w) END AS r2 FROM st1),
    st3 AS (SELECT *, CASE WHEN ends_with(w, 'erinnen') THEN 7 WHEN ends_with(w, 'erin') THEN 4 WHEN regexp_matches(w, '(ern|lns)$') THEN 3 WHEN regexp_matches(w, '(em|er|en|es|ln)$') THEN 2 WHEN regexp_matches(w, '(e|s)$') THEN 1 ELSE 0 END AS n FROM st2),
    st4 AS (SELECT word, r1, r2, CASE WHEN n = 0 OR length(w) - n < r1 THEN w WHEN n IN (4, 7) THEN {cut('n')} || 'er' WHEN regexp_matches(w, 'lns?$') THEN {cut('n')} || 'l'
        WHEN ends_with(w, 'em') THEN CASE WHEN ends_with(w, 'system') THEN w ELSE {cut(2)} END WHEN regexp_matches(w, 'ern?$') THEN {cut('n')}
        WHEN regexp_matches(w, 'e[ns]?$') THEN CASE WHEN regexp_matches(w, 'nisse[ns]?$') THEN {cut('n - 1')} ELSE {cut('n')} END WHEN regexp_matches(w, '[{BEFORE_S}]s$') THEN {cut(1)} ELSE w END AS w FROM st3),
    st5 AS (SELECT *, CASE WHEN ends_with(w, 'est') THEN 3 WHEN regexp_matches(w, '(en|er|et|st)$') THEN 2 ELSE 0 END AS n FROM st4),
    st6 AS (SELECT word, r1, r2, CASE WHEN n = 0 OR length(w) - n < r1 THEN w WHEN n = 3 OR regexp_matches(w, 'e[nr]$') THEN {cut('n')} WHEN ends_with(w, 'st') THEN CASE WHEN regexp_matches(w, '...[{BEFORE_ST}]st$') THEN {cut(2)} ELSE w END
        WHEN regexp_matches(w, '[{BEFORE_ET}]et$') AND NOT regexp_matches(w, '({'|'.join(KEEPS_ET)})et$') THEN {cut(2)} ELSE w END AS w FROM st5),
    st7 AS (SELECT word, r1, r2, w AS whole, CASE WHEN regexp_matches(w, '(lich|heit|keit|isch)$') THEN 4 WHEN regexp_matches(w, '(end|ung)$') THEN 3 WHEN regexp_matches(w, 'i[gk]$') THEN 2 ELSE 0 END AS n,
        regexp_matches(w, '(isch|i[gk])$') AS soft FROM st6),
    st8 AS (SELECT word, r1, r2, CASE WHEN n = 0 OR length(whole) - n < r2 OR soft AND regexp_matches(left(whole, length(whole) - n), 'e$') THEN '' ELSE right(whole, n) END AS last, whole FROM st7),
    st9 AS (SELECT word, r1, r2, last, left(whole, length(whole) - length(last)) AS w FROM st8),
    stems AS (SELECT word, translate(CASE WHEN last IN ('end', 'ung') AND ends_with(w, 'ig') AND NOT ends_with(w, 'eig') AND length(w) - 2 >= r2 THEN {cut(2)} WHEN last IN ('lich', 'heit') AND regexp_matches(w, 'e[rn]$') AND length(w) - 2 >= r1 THEN {cut(2)}
        WHEN last = 'keit' AND ends_with(w, 'lich') AND length(w) - 4 >= r2 THEN {cut(4)} WHEN last = 'keit' AND ends_with(w, 'ig') AND length(w) - 2 >= r2 THEN {cut(2)} ELSE w END, 'UYäöü', 'uyaou') AS stem FROM st9)"""
