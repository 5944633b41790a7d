"""Byte-level BPE encoding and decoding through a memory-mapped word transducer.

Frequent words of the corpus (an exact-enough lossy count, see :func:`frequent_words`)
are encoded once and compiled into a minimal acyclic transducer: states with equal
futures are shared, and numbers on the arcs add up to the word's index, which
names its ids. The flat file reaches the executors with ``SparkContext.addFile``,
is mapped read-only, and so is held once per machine. Words it does not know are
merged exactly: rank by rank, leftmost first, many words at a time.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import mmap
import os
import uuid
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.session import materialise

#: Words go into the lexicon if they are at least this share of all words, so there are at most as many as its inverse.
LEXICON_SHARE = 1 / 65536
#: Words that a counter or cache holds before it is flushed; bytes of text encoded at a time.
HELD, TEXT_AT_ONCE = 400_000, 4_000_000
#: Letters and digits newer than the Unicode version of the tokenizer's library, for which they are neither.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 "
    "10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F 12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 16FF4-16FF6 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 "
    "1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD "
    "323B0-33479 3D000-3FC3F "
).split()
#: Kinds of characters to the pattern.
BLANK, LETTER, NUMBER, OTHER = range(4)


@functools.cache
def character_kinds() -> bytes:
    """The kind of every code point, as one byte each."""
    points = "".join(map(chr, range(0xD800))) + "\0" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((BLANK, r"\s+"), (LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
        for m in regex.finditer(pattern, points):
            kinds[m.start() : m.end()] = kind
    for run in NEWER:
        first, _, last = run.partition("-")
        kinds[int(first, 16) : int(last or first, 16) + 1] = OTHER
    return kinds.tobytes()


def word_starts(points: np.ndarray, starts: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the tokenizer's pattern cuts: a mark for each code point of texts that begin at ``starts``.

    The pattern's words are a contraction, a run of one kind with the space before
    it, or white space. White space before a word keeps its last character apart.
    """
    n = len(points)
    kind = kinds[points]
    edge = np.zeros(n + 1, bool)
    edge[starts] = edge[n] = True
    blank = np.concatenate([kind == BLANK, [True]])
    change = np.ones(n + 1, bool)
    np.not_equal(kind[1:], kind[:-1], out=change[1:n])
    last = blank[:n] & ~blank[1:] & ~edge[1:]  # white space that a word follows
    cut = edge[:n] | change[:n] | last
    # The space goes with its word.
    led = np.flatnonzero(last & (points == 32)) + 1
    cut[led] = False
    quote = np.flatnonzero(cut & (points == 39))
    if len(quote):
        stop = np.append(starts, n)[np.searchsorted(starts, quote, side="right")]
        after = [np.where(quote + k < stop, points[np.minimum(quote + k, n - 1)], 0) for k in (1, 2)]
        two = np.isin(after[0], [ord(c) for c in "stmd"])
        three = np.zeros(len(quote), bool)
        for x, y in ("re", "ve", "ll"):
            three |= (after[0] == ord(x)) & (after[1] == ord(y))
        for found, length in ((quote[two], 2), (quote[three], 3)):
            cut[found + 1] = False
            cut[found[found + length < n] + length] = True
    return cut


def words_of(texts: pa.StringArray, kinds: np.ndarray) -> tuple[pa.StringArray, np.ndarray]:
    """All words of the texts one after another, and where each text's words begin (one more entry than texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if offsets[0] == offsets[-1]:
        return pa.array([], pa.string()), np.zeros(len(texts) + 1, np.int64)
    held = texts.buffers()[2].slice(offsets[0], offsets[-1] - offsets[0])
    offsets -= offsets[0]
    data = np.frombuffer(held, np.uint8)
    points = np.frombuffer(str(held, "utf-8").encode("utf-32-le"), np.uint32)
    place = None if len(points) == len(data) else np.flatnonzero((data & 0xC0) != 0x80)
    full = offsets[:-1][offsets[1:] > offsets[:-1]]
    cut = np.flatnonzero(word_starts(points, full if place is None else np.searchsorted(place, full), kinds))
    cut = np.append(cut if place is None else place[cut], len(data))
    found = pa.StringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut.astype(np.int32)), held)
    return found, np.searchsorted(cut, offsets)


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary, reversed."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """The ids, bytes and merges of a byte-level BPE tokenizer file."""

    def __init__(self, source: str) -> None:
        spec = json.loads(source)
        model, alphabet = spec["model"], byte_alphabet()
        ids = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for token, i in ids.items():
            self.bytes[i] = bytes(alphabet[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = np.zeros(256, np.int64)
        for c, b in alphabet.items():
            self.of_byte[b] = ids[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([ids[a] << 20 | ids[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.made = np.array([ids[a + b] for a, b in pairs], np.int64)

    def merge(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all words in some order, and where each word's ids begin and how many they are."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = self.of_byte[np.frombuffer(words.buffers()[2] or b"", np.uint8)]
        length = np.diff(offsets)
        order = np.argsort(length, kind="stable")
        begin, count, flat, total, at = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), [], 0, 0
        while at < len(order):
            limit = max(8, length[order[at]] * 5 // 4)
            stop = min(np.searchsorted(length, limit, side="right", sorter=order), at + max(1, 400_000 // limit))
            group = order[at:stop]
            if limit > 256:
                ids = [self._merge_long(data[offsets[i] : offsets[i + 1]]) for i in group]
                count[group], own = list(map(len, ids)), np.concatenate(ids)
            else:
                count[group], own = self._merge_group(data, offsets[group], length[group])
            begin[group] = total + np.cumsum(count[group]) - count[group]
            flat.append(own)
            total, at = total + len(own), stop
        return np.concatenate(flat).astype(np.uint32) if flat else np.empty(0, np.uint32), begin, count

    def _merge_group(self, data: np.ndarray, starts: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and the ids. One merge per word and turn: the least rank, leftmost."""
        width, none = int(length.max(initial=0)), len(self.made)
        cols = np.arange(width + 1)
        inside = cols < length[:, None]
        table = np.full((len(length), width + 1), -1, np.int64)
        table[inside] = data[(starts[:, None] + cols)[inside]]
        done, done_length = np.full((len(length), width), -1, np.int64), length.copy()
        rows, ranks = np.arange(len(length)), self._ranks(table[:, :-1], table[:, 1:])
        while len(rows) and ranks.shape[1]:
            best = ranks.argmin(axis=1)
            rank = ranks[np.arange(len(rows)), best]
            ended = rank == none
            if ended.any():
                out = table[ended]
                done[rows[ended], : min(width, out.shape[1])] = out[:, :width]
                done_length[rows[ended]] = length[ended]
                live = ~ended
                rows, table, ranks, length, best, rank = rows[live], table[live], ranks[live], length[live], best[live], rank[live]
                if not len(rows):
                    break
            length = length - 1
            i = np.arange(len(rows))
            table[i, best] = self.made[rank]
            # What stands right of the merged pair moves one place to the left.
            shift = cols[: table.shape[1] - 1] > best[:, None]
            table = np.where(shift, table[:, 1:], table[:, :-1])
            ranks = np.where(shift[:, :-1], ranks[:, 1:], ranks[:, :-1])
            if ranks.shape[1]:
                inner = np.flatnonzero(best < ranks.shape[1])
                ranks[inner, best[inner]] = self._ranks(table[inner, best[inner]], table[inner, best[inner] + 1])
                left = np.flatnonzero(best > 0)
                ranks[left, best[left] - 1] = self._ranks(table[left, best[left] - 1], table[left, best[left]])
        if len(rows):
            done[rows, : table.shape[1]] = table[:, :width]
            done_length[rows] = length
        return done_length, done[np.arange(width) < done_length[:, None]]

    @functools.cached_property
    def rank_of(self) -> dict[tuple[int, int], int]:
        return {(k >> 20, k & 0xFFFFF): r for k, r in zip(self.keys.tolist(), self.ranks.tolist(), strict=True)}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.ranks[at], len(self.made)).astype(np.int32)

    def _merge_long(self, word: np.ndarray) -> list[int]:
        """One long word, given as the ids of its bytes: a heap of merges over a linked list."""
        ids = word.tolist()
        n, none = len(ids), len(self.made)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        first = self._ranks(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i) for i, r in enumerate(first) if r < none]
        heapq.heapify(heap)
        ranks = self.rank_of
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j < 0 or ranks.get((ids[i], ids[j])) != rank:
                continue
            ids[i], ids[j], after[i] = int(self.made[rank]), -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (r := ranks.get((ids[a], ids[b]))) is not None:
                    heapq.heappush(heap, (r, a))
        return [i for i in ids if i >= 0]


class Lexicon:
    """A minimal acyclic transducer from words to ids, in one flat file."""

    @staticmethod
    def compile(entries: Iterable[tuple[bytes, list[int]]]) -> bytes:
        """Words must differ. States are shared by their signature as sorted words leave them behind."""
        entries = sorted(entries)
        register: dict[tuple, int] = {}
        arcs: list[tuple[bool, list[tuple[int, int]]]] = []

        def freeze(state: list) -> int:
            signature = (state[0], tuple(state[1]))
            if signature not in register:
                register[signature] = len(arcs)
                arcs.append((state[0], list(state[1])))
            return register[signature]

        path: list[list] = [[False, []]]
        last = b""
        for word, _ in [*entries, (b"", [])]:
            common = len(os.path.commonprefix([last, word]))
            for depth in range(len(last), common, -1):
                path[depth - 1][1].append((last[depth - 1], freeze(path.pop())))
            path += [[False, []] for _ in word[common:]]
            path[-1][0] = path[-1][0] or word != b""
            last = word
        root = freeze(path[0])
        paths = []  # words below each state: targets are frozen before the states that lead to them
        for final, out in arcs:
            paths.append(final + sum(paths[t] for _, t in out))
        first, label, target, add = [0], [], [], []
        for final, out in arcs:
            passed = int(final)
            for byte, t in out:
                label.append(byte)
                target.append(t)
                add.append(passed)
                passed += paths[t]
            first.append(len(label))
        ids = [i for _, word_ids in entries for i in word_ids]
        starts = np.cumsum([0, *[len(word_ids) for _, word_ids in entries]])
        arc = np.repeat(np.arange(len(arcs)), np.diff(first)) << 8 | np.array(label, np.int64)
        parts = [arc, target, add, starts, ids, [int(final) for final, _ in arcs]]
        head = np.array([root, *map(len, parts)], np.int64)
        return head.tobytes() + b"".join(np.asarray(p, kind).tobytes() for p, kind in zip(parts, Lexicon.KINDS, strict=True))

    #: Kinds of the parts: arcs as ``state << 8 | byte`` in order, their targets, the numbers on them, where each word's ids start, ids, final states.
    KINDS = (np.int64, np.int32, np.int32, np.int32, np.uint32, np.uint8)

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.root, *sizes = np.frombuffer(self.map, np.int64, 1 + len(self.KINDS)).tolist()
        at, parts = 8 * (1 + len(self.KINDS)), []
        for size, kind in zip(sizes, self.KINDS, strict=True):
            parts.append(np.frombuffer(self.map, kind, size, at))
            at += size * np.dtype(kind).itemsize
        self.arc, self.target, self.add, self.starts, self.ids, self.final = parts

    def find(self, words: pa.StringArray) -> np.ndarray:
        """The index of each word, or -1: all words take their steps through the states together."""
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = np.frombuffer(words.buffers()[2] or b"", np.uint8)
        out, length = np.full(len(words), -1, np.int64), np.diff(offsets)
        live = np.arange(len(words)) if len(self.arc) else np.empty(0, np.int64)
        state, index, step = np.full(len(live), self.root, np.int64), np.zeros(len(live), np.int64), 0
        while len(live):
            done = length[live] == step
            ends = done & (self.final[state] > 0)
            out[live[ends]] = index[ends]
            live, state, index = live[~done], state[~done], index[~done]
            arc = state << 8 | data[offsets[live] + step]
            at = np.minimum(np.searchsorted(self.arc, arc), len(self.arc) - 1)
            known = self.arc[at] == arc
            at, live = at[known], live[known]
            state, index, step = self.target[at].astype(np.int64), index[known] + self.add[at], step + 1
        return out


class Codec:
    """Encodes and decodes whole texts; lives in a worker process and keeps what it has merged between batches."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon | None, kinds: bytes | None = None) -> None:
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.kinds = np.frombuffer(kinds or character_kinds(), np.uint8)
        self.special = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.decoder = pa.array(vocabulary.bytes, pa.binary())
        self.forget()

    def forget(self) -> None:
        """Only the lexicon stays known."""
        own = self.lexicon
        self.flat = own.ids if own else np.empty(0, np.uint32)
        self.begin = own.starts[:-1].astype(np.int64) if own else np.empty(0, np.int64)
        self.count = np.diff(own.starts).astype(np.int64) if own else np.empty(0, np.int64)
        self.known: dict[str, int] = {}

    def _rows(self, words: pa.StringArray) -> np.ndarray:
        """The row of ``begin`` and ``count`` for each (distinct) word's ids; new words are merged together."""
        rows = self.lexicon.find(words) if self.lexicon else np.full(len(words), -1, np.int64)
        rest = np.flatnonzero(rows < 0)
        texts = words.take(pa.array(rest))
        names = texts.to_pylist()
        fresh = [i for i, w in enumerate(names) if w not in self.known]
        if len(fresh) + len(self.known) > HELD:
            self.forget()
            fresh = range(len(names))
        if len(fresh):
            ids, begin, count = self.vocabulary.merge(texts.take(pa.array(fresh, pa.int64())))
            self.known.update(zip([names[i] for i in fresh], range(len(self.begin), len(self.begin) + len(fresh)), strict=True))
            self.begin, self.count = np.concatenate([self.begin, begin + len(self.flat)]), np.concatenate([self.count, count])
            self.flat = np.concatenate([self.flat, ids])
        rows[rest] = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        return rows

    def _plain(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without special tokens, one after another, and where each text's begin."""
        found, begins = words_of(texts, self.kinds)
        if not len(found):
            return np.empty(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        coded = found.dictionary_encode()
        rows = self._rows(coded.dictionary)[coded.indices.to_numpy()]
        first, count = self.begin[rows], self.count[rows]
        ends = np.cumsum(count)
        ids = self.flat[np.repeat(first - (ends - count), count) + np.arange(ends[-1])]
        return ids, np.concatenate([[0], ends])[begins]

    def encode(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts, one after another, and where each text's begin."""
        texts = texts.fill_null("")
        marked = np.zeros(len(texts), bool)
        for special in self.vocabulary.special:
            marked |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        if not marked.any():
            return self._plain(texts)
        # Texts with special tokens fall into parts; each special token is a part of its own.
        parts, last, special = [], [], {}
        for text, cut in zip(texts.to_pylist(), marked.tolist(), strict=True):
            for part in self.special.split(text) if cut else [text]:
                if cut and part in self.vocabulary.special:
                    special[len(parts)] = self.vocabulary.special[part]
                    part = ""
                parts.append(part)
            last.append(len(parts))
        ids, begins = self._plain(pa.array(parts, pa.string()))
        at = np.fromiter(special, np.int64, len(special))
        ids = np.insert(ids, begins[at], np.fromiter(special.values(), np.uint32, len(special)))
        begins = begins + np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(parts)))])
        return ids, begins[np.array([0, *last])]

    def decode(self, ids: np.ndarray, begins: np.ndarray) -> pa.StringArray:
        """The texts that stretches of ids stand for; bytes that are no UTF-8 become replacement marks."""
        taken = self.decoder.take(pa.array(ids))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(ids) + 1][begins]
        data = taken.buffers()[2] or pa.py_buffer(b"")
        out = pa.StringArray.from_buffers(len(begins) - 1, pa.py_buffer(offsets.astype(np.int32)), data)
        try:
            out.validate(full=True)
        except pa.ArrowInvalid:
            out = pa.array([bytes(data[a:b]).decode("utf-8", "replace") for a, b in itertools.pairwise(offsets.tolist())], pa.string())
        return out

    def code(self, texts: pa.StringArray) -> tuple[pa.Array, pa.BinaryArray, pa.StringArray]:
        """For each text, the number of its ids, the ids as little-endian 32-bit integers, and what they decode to."""
        ids, begins = self.encode(texts)
        own = pa.BinaryArray.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((4 * begins).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
        return pa.array(np.diff(begins)), own, self.decode(ids, begins)


_codecs: dict[str, Codec] = {}
_served: set[tuple[str, str]] = set()


def _codec(name: str, source: str | None, kinds: bytes) -> Codec:
    if name not in _codecs:
        _codecs.clear()
        _codecs[name] = Codec(Vocabulary(source), Lexicon(SparkFiles.get(name)), kinds)
    return _codecs[name]


def _texts_at_once(texts: pa.StringArray) -> Iterator[tuple[int, pa.StringArray]]:
    """Slices of a batch of about TEXT_AT_ONCE bytes, and where they start."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    group = np.cumsum(sizes) // TEXT_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]
    for a, b in itertools.pairwise(cuts):
        if b > a:
            yield a, texts.slice(a, b - a)


def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same batches; before each, and at the end, Arrow gives back what earlier ones (or another stage in this worker) have left in its pool."""
    pool = pa.default_memory_pool()
    pool.release_unused()
    for batch in batches:
        yield batch
        del batch
        pool.release_unused()


def frequent_words(docs: DataFrame, share: float = LEXICON_SHARE) -> DataFrame:
    """``word, n``: the tokenizer's words that make up at least ``share`` of the corpus, by a lossy count over all rows.

    A task leaves out words below a quarter of that share of its own; counts are so
    at most a quarter of the share too low. This only decides what the lexicon
    holds, never what a text is encoded as.
    """
    sent = docs.sparkSession.sparkContext.broadcast(character_kinds())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = np.frombuffer(sent.value, np.uint8)

        def summed(tables: list[pa.Table]) -> pa.Table:
            return pa.concat_tables(tables).group_by("word").aggregate([("n", "sum")]).rename_columns(["word", "n"])

        def flush(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
            found = summed(tables)
            total = pc.sum(found["n"]).as_py() or 0
            kept = found.filter(pc.greater_equal(found["n"], max(2, share / 4 * total))) if len(found) > 5000 else found
            whole = pa.table({"word": pa.array([None], pa.string()), "n": pa.array([total], pa.int64())})
            yield from pa.concat_tables([kept, whole]).combine_chunks().to_batches(max_chunksize=10_000)

        held: list[pa.Table] = []
        rows = 0
        for batch in released(batches):
            for _, texts in _texts_at_once(batch.column("text")):
                word, n = words_of(texts.fill_null(""), kinds)[0].value_counts().flatten()
                held.append(pa.table({"word": word, "n": n}))
                rows += len(word)
                if rows > HELD:
                    held = [summed(held)]
                    rows = len(held[0])
                    if 2 * rows > HELD:
                        yield from flush(held)
                        held, rows = [], 0
        if held:
            yield from flush(held)

    counted = docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "bpe-words")
    total = counted.where("word is null").select(F.col("n").alias("total"))
    return counted.where("word is not null").join(F.broadcast(total)).where(F.col("n") >= F.col("total") * share).select("word", "n")


def build_lexicon(docs: DataFrame, tokenizer: str, share: float = LEXICON_SHARE) -> str:
    """Compiles the lexicon and sends its file to all executors; returns the file's name there."""
    spark = docs.sparkSession
    source = spark.sparkContext.broadcast(Path(tokenizer).read_text())

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vocabulary = Vocabulary(source.value)
        for batch in batches:
            ids, begin, count = vocabulary.merge(pa.array(batch["word"], pa.string()))
            yield pd.DataFrame({"word": batch["word"], "ids": [ids[a : a + n].astype(np.int32) for a, n in zip(begin, count, strict=True)]})

    # At most 1 / share rows.
    rows = frequent_words(docs, share).select("word").mapInPandas(encode, "word string, ids array<int>").collect()
    flat = Lexicon.compile((r["word"].encode(), r["ids"]) for r in rows)
    name = f"lexicon-{hashlib.sha256(flat).hexdigest()[:16]}.fst"
    # The driver serves the file from the folder that Spark keeps for such files and clears at the end; one that is served cannot be added from another path.
    if (spark.sparkContext.applicationId, name) not in _served:
        path = Path(SparkFiles.getRootDirectory(), f"served-{uuid.uuid4().hex}", name)
        path.parent.mkdir(parents=True)
        path.write_bytes(flat)
        spark.sparkContext.addFile(str(path))
        _served.add((spark.sparkContext.applicationId, name))
    return name


def encode_documents(docs: DataFrame, tokenizer: str, share: float = LEXICON_SHARE) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs(doc_id, text)``.

    ``ids`` are little-endian unsigned 32-bit integers in a binary, ``decoded`` is the
    text that they decode to. A null text is an empty one: no tokens. A null
    ``doc_id`` is kept, repeated rows give repeated rows, other columns are ignored.
    Special tokens' strings in a text become their ids, as the tokenizer's own
    library does by default.
    """
    spark = docs.sparkSession
    name = build_lexicon(docs, tokenizer, share)
    source = spark.sparkContext.broadcast(Path(tokenizer).read_text())
    kinds = spark.sparkContext.broadcast(character_kinds())
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(name, source.value if name not in _codecs else None, kinds.value)
        for batch in released(batches):
            for at, texts in _texts_at_once(batch.column("text")):
                columns = [batch.column("doc_id").slice(at, len(texts)), *codec.code(texts)]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"])
                del columns, texts
        codec.forget()  # a worker may do other work next

    return docs.select("doc_id", "text").mapInArrow(encode, f"doc_id {kind}, n_tokens long, ids binary, decoded string")
