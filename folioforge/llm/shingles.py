"""Word shingles as 64-bit hashes, for a whole batch of texts at a time."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Odd multipliers: of a byte by its place in a word, of the words' hashes by place, and of the number of words in a short text.
BYTE = 0xD1342543DE82EF95
PLACES = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)
#: Bytes of text worked on at once; more only for a single longer text.
TEXT_AT_ONCE = 1_000_000
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: A random number for each byte value, from a fixed seed.
VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(33)) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ x >> np.uint64(29)) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(32)


class _Powers:
    """Powers of BYTE and of its inverse modulo 2^64, as many as were ever needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, x, np.uint64)])) for x in (BYTE, pow(BYTE, -1, 1 << 64)))
        return self.up, self.down


_powers = _Powers()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts ``data[offsets[i]:offsets[i + 1]]``, and where each text's words begin.

    A word is a run without ASCII white space, A-Z in lower case.
    """
    inside = ~SPACE[data]
    change = np.empty(len(data) + 1, bool)
    change[0] = change[-1] = True
    np.not_equal(inside[1:], inside[:-1], out=change[1:-1])
    change[offsets] = True
    edges = np.flatnonzero(change)
    word = np.append(inside, False)[edges[:-1]] if len(edges) > 1 else np.empty(0, bool)
    first, last = edges[:-1][word], edges[1:][word]
    up, down = _powers.reach(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(VALUES[LOWER[data]] * up[: len(data)])])
    hashes = _mixed((sums[last] - sums[first]) * down[first] + (last - first).astype(np.uint64))
    return hashes, np.searchsorted(first, offsets)


def shingle_sets(texts: pa.StringArray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of all runs of ``size`` words of each text, one text after another, and where each text's begin.

    A text with fewer words has its whole sequence as one shingle, a null text or one
    without words none.
    """
    texts = texts.fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.empty(0, np.uint8)
    each, begins = word_hashes(data, offsets - offsets[0])
    count = np.diff(begins)
    found, owner = [], []
    long = count >= size
    if long.any():
        n = len(each) - size + 1
        mixed = np.zeros(n, np.uint64)
        for i in range(size):
            mixed += each[i : i + n] * PLACES[i % 5] ^ np.uint64(i // 5)
        own = np.repeat(np.arange(len(count)), count)
        full = own[:n] == own[size - 1 :]
        found.append(mixed[full])
        owner.append(own[:n][full])
    for i in np.flatnonzero(~long & (count > 0)):
        words = each[begins[i] : begins[i + 1]]
        found.append((words * PLACES[np.arange(len(words)) % 5]).sum(keepdims=True, dtype=np.uint64) + np.array([len(words)], np.uint64) * PLACES[4])
        owner.append(np.array([i]))
    if not found:
        return np.empty(0, np.int64), np.zeros(len(count) + 1, np.int64)
    hashes, own = _mixed(np.concatenate(found)).view(np.int64), np.concatenate(owner)
    order = np.lexsort((hashes, own))
    hashes, own = hashes[order], own[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (own[1:] != own[:-1]))
    hashes, own = hashes[new], own[new]
    return hashes, np.searchsorted(own, np.arange(len(count) + 1))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """The same for one text."""
    return shingle_sets(pa.array([text], pa.string()), size)[0]


def slices(texts: pa.StringArray, at_once: int = TEXT_AT_ONCE) -> Iterator[tuple[int, pa.StringArray]]:
    """Slices of about ``at_once`` bytes of text, and where they start."""
    if not len(texts):
        return
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy()
    group = np.cumsum(sizes.astype(np.int64)) // at_once
    for a, b in itertools.pairwise([0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(texts)]):
        yield a, texts.slice(a, b - a)
