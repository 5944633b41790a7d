"""Quality rules: counts of words, symbols, repeated lines and windows, and compression bands.

A text that compresses far better than prose of its length repeats itself; one that
hardly compresses is noise. zstandard's ratio depends on the length, so the limits do:
``BANDS`` lists them by length in bytes. They hold for the whole text and, each by its
own length, for its fixed chunks, of which only a share may lie outside: a table or a
list inside a long text does not reject it.

One pass without a shuffle: each row is judged by itself, in the task that reads it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

#: (shorter than so many bytes, lowest ratio, highest ratio) of compressed to plain size; the last holds beyond.
#: Prose lies well inside at every length; shorter texts than the first limit are not judged by ratio.
BANDS = ((128, 0.0, float("inf")), (512, 0.42, 0.90), (1024, 0.40, 0.80), (2048, 0.36, 0.72), (4096, 0.32, 0.68), (16_384, 0.28, 0.65), (2**62, 0.25, 0.65))
CHUNK = 2048
#: At most this share of a text's bytes may be in chunks outside their band.
BAD_CHUNKS = 1 / 3
LEVEL = 3
FEWEST_WORDS, MOST_REPEATED = 50, 50
SPACE, SYMBOLS = " \t\n\v\f\r", "#*$%&|<>"
REASONS = ("words", "windows", "repetitive", "incompressible", "repetitive chunks", "incompressible chunks")
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, n_chunks long, n_bad_chunks long, reason string"


def repeated_words(words: list[bytes]) -> int:
    """How many words lie in windows of three that occur twice or more, the first occurrence included."""
    n = len(words)
    if n < 4:
        return 0
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(number.__getitem__, words), np.int64, n)
    pair = ids[:-2] * len(number) + ids[1:-1]
    if len(number) > 2_000_000:  # three ids would not fit 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    _, which, count = np.unique(pair * len(number) + ids[2:], return_inverse=True, return_counts=True)
    again = count[which] > 1
    covered = np.zeros(n, bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= again
    return int(covered.sum())


def outside(ratio: float, size: int, bands: tuple = BANDS) -> int:
    """-1 below the band of the length, 1 above it, 0 inside."""
    low, high = next((low, high) for limit, low, high in bands if size < limit)
    return -1 if ratio < low else 1 if ratio > high else 0


def chunk_verdicts(data: bytes, squeeze: zstandard.ZstdCompressor, size: int, bands: tuple) -> list[tuple[int, int]]:
    """``(length, outside)`` of each chunk of ``size`` bytes; the last may be shorter."""
    found = []
    for at in range(0, len(data), size):
        part = data[at : at + size]
        found.append((len(part), outside(len(squeeze.compress(part)) / len(part), len(part), bands)))
    return found


def _judge(text: str, squeeze: zstandard.ZstdCompressor, bands: tuple, size: int) -> tuple:
    data = text.encode()
    words = data.split()  # at the same six characters
    lines = [line for line in text.split("\n") if line.strip(SPACE)]
    repeated = repeated_words(words)
    counts = (len(words), len(text) - sum(map(text.count, SPACE)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated)
    if not data:
        return *counts, None, 0, 0, REASONS[0]
    ratio = len(squeeze.compress(data)) / len(data)
    chunks = chunk_verdicts(data, squeeze, size, bands)
    bad = [sum(n for n, side in chunks if side == which) for which in (-1, 1)]
    whole = outside(ratio, len(data), bands)
    failed = (len(words) < FEWEST_WORDS, 100 * repeated > MOST_REPEATED * len(words), whole < 0, whole > 0, *(b > BAD_CHUNKS * len(data) for b in bad))
    return *counts, ratio, len(chunks), sum(side != 0 for _, side in chunks), next((r for r, f in zip(REASONS, failed, strict=True) if f), None)


def judge_documents(docs: DataFrame, bands: tuple = BANDS, chunk: int = CHUNK) -> DataFrame:
    """``doc_id``, counts, ``ratio, n_chunks, n_bad_chunks``, ``reason, base_failed, kept`` for every row of ``docs(doc_id, text)``.

    ``reason`` is the first rule that rejects the text, null for a kept one; the first
    two are the base rules. A null text is an empty one: no words, no ratio, rejected.
    A null ``doc_id`` is kept as it is, repeated rows get equal rows, other columns are
    ignored, and texts are judged whole.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        for batch in batches:
            rows = [_judge(text.as_py() or "", squeeze, bands, chunk) for text in batch.column("text")]
            types = [pa.int64()] * 5 + [pa.float64(), pa.int64(), pa.int64(), pa.string()]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *[c.split()[0] for c in COLUMNS.split(", ")]])

    found = docs.select("doc_id", "text").mapInArrow(judge, f"doc_id {kind}, {COLUMNS}")
    base = f"coalesce(reason in ('{REASONS[0]}', '{REASONS[1]}'), false)"
    return found.selectExpr("*", f"{base} as base_failed", "reason is null as kept")
