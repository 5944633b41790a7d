"""Secret scans: single credentials, and credentials in several parts.

A pass over the texts finds base spans (assignments, access keys, long hex) and
weak parts: access identifiers, secrets and endpoints that say little alone.
Spark then joins the parts of each document and scope by interval: a weak secret
counts when an identifier lies within ``WINDOW`` characters of it in the same
scope, a weak identifier when a secret does, an endpoint when both do. Base spans
take part as identifiers (access) or secrets (assign, hex), and always stay. The
interval join is a sweep in order of place (running nearest neighbours), so that
many parts in one scope never multiply.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.session import materialise

WINDOW = 200
#: In the order in which spans with the same start are listed.
KINDS = ("assign", "access", "hex", "id", "secret", "endpoint")
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Names before = or :, of identifiers, secrets and endpoints; then values. Other name characters may stand before a name (DB_USER).
PAIR = re.compile(
    r"""(?i:(?:(user(?:_?name)?|login|account|client_?id|access_?key(?:_?id)?|app_?id|tenant)"""
    r"""|(pwd|pw|pass|passphrase|auth|credential|client_?secret|secret_?access_?key|secret_?key|private_?key|signature|sig)"""
    r"""|(host(?:name)?|server|endpoint|url|uri|address|database|db)))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.@:=-]{3,})""",
    re.ASCII,
)
URL = re.compile(r"[A-Za-z][A-Za-z0-9+.-]{1,15}://[^\s\"'<>]{3,}", re.ASCII)
#: A run that may be a value; it counts with digits, capitals and small letters in it.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", re.ASCII)
CLASSES = [re.compile(c) for c in ("[0-9]", "[A-Z]", "[a-z]")]

SCANNED = "doc_id {id}, tag string, n_assign long, n_access long, n_hex long, base string, parts array<struct<scope:int,kind:int,start:int,stop:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, end, kind)`` of the single credentials; leftmost, not overlapping within a kind."""
    low, found = text.lower(), []
    if any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    # The runs of the other two kinds are as long as they can be, so a least length in the pattern drops the same matches.
    found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def weak_spans(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Parts that need company, apart from what the base spans hold already. A URL may hold base spans and parts."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), m.end(), 3 if m[1] else 4 if m[2] else 5) for m in PAIR.finditer(text)]
        found += [(m.start(), m.end(), 5) for m in URL.finditer(text)] if "://" in text else []
    if not found and not base:
        return []
    found += [(m.start(), m.end(), 4) for m in RUN.finditer(text) if all(c.search(m[0]) for c in CLASSES)]
    stops, free, at, url_at = [s[1] for s in base], [], 0, 0
    longest = list(stops)
    for i in range(1, len(longest)):
        longest[i] = max(longest[i], longest[i - 1])
    starts = [s[0] for s in base]
    urls = {m.span() for m in URL.finditer(text)} if "://" in text else set()
    for span in sorted(found):
        # A URL is an endpoint beside the identifiers and secrets that it holds; other endpoints in it are part of it.
        url = span[2] == 5 and span[:2] in urls
        i = bisect.bisect_right(starts, span[0]) if url else bisect.bisect_left(starts, span[1])
        if span[0] < at or (i and longest[i - 1] > span[0]) or (span[2] == 5 and span[0] < url_at):
            continue
        free.append(span)
        if url:
            url_at = span[1]
        else:
            at = span[1]
    return free


PARTS = pa.list_(pa.struct([(name, pa.int32()) for name in ("scope", "kind", "start", "stop")]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        tags, counts, spans, every = [], ([], [], []), [], []
        for text in batch.column("text").to_pylist():
            text = text or ""
            base = base_spans(text)
            weak = weak_spans(text, base)
            parts = None
            if weak:
                breaks = [m.start() for m in re.finditer(r"\n[ \t]*\n", text)]
                parts = [{"scope": bisect.bisect_right(breaks, s[0]), "kind": s[2], "start": s[0], "stop": s[1]} for s in sorted(base + weak)]
            tags.append(hashlib.md5(text.encode()).hexdigest())
            for k in range(3):
                counts[k].append(sum(s[2] == k for s in base))
            spans.append(",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in base))
            every.append(parts)
        columns = [batch.column("doc_id"), pa.array(tags, pa.string()), *[pa.array(n, pa.int64()) for n in counts], pa.array(spans, pa.string()), pa.array(every, PARTS)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "tag", "n_assign", "n_access", "n_hex", "base", "parts"])


def _near(is_kind: Column, scope: Window) -> Column:
    """Whether a part of the kind lies within the window before or after, in the scope."""
    before = F.max(F.when(is_kind, F.col("stop"))).over(scope.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(F.when(is_kind, F.col("start"))).over(scope.rowsBetween(1, Window.unboundedFollowing))
    return F.coalesce(F.col("start") - before <= WINDOW, F.lit(False)) | F.coalesce(after - F.col("stop") <= WINDOW, F.lit(False))


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base, spans`` for every row of ``docs(doc_id, text)``.

    ``base`` and ``spans`` list ``kind:start:end`` in code points, end exclusive,
    by start and then kind. A null text is an empty one: no spans. A null
    ``doc_id`` is a value like any other. Repeated rows each get their own equal
    row. Other columns are ignored. Texts are scanned whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    found = docs.select("doc_id", "text").mapInArrow(_scan, SCANNED.format(id=kind))
    found = materialise(found, "secret-scan")
    parts = found.where("parts is not null").dropDuplicates(["doc_id", "tag"]).select("doc_id", "tag", F.inline("parts"))
    scope = Window.partitionBy("doc_id", "tag", "scope").orderBy("start", "kind", "stop")
    name = F.col("kind")
    parts = parts.withColumn("by_id", _near(name.isin(1, 3), scope)).withColumn("by_secret", _near(name.isin(0, 2, 4), scope))
    parts = parts.where((name < 3) | ((name == 3) & F.col("by_secret")) | ((name == 4) & F.col("by_id")) | ((name == 5) & F.col("by_id") & F.col("by_secret")))
    linked = parts.groupBy("doc_id", "tag").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "stop"))).alias("all"))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = F.array_join(F.transform("all", lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"], s["stop"])), ",")
    linked = materialise(linked.select(F.col("doc_id").alias("_id"), F.col("tag").alias("_tag"), spans.alias("linked")), "secret-links")
    joined = found.join(linked.hint("merge"), found["doc_id"].eqNullSafe(linked["_id"]) & (found["tag"] == linked["_tag"]), "left")
    return joined.select("doc_id", "n_assign", "n_access", "n_hex", "base", F.coalesce("linked", "base").alias("spans"))
