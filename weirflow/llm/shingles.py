"""Words of texts, and runs of five words, as hashes.

A word is a stretch between white space, as str.split() has it. Its hash is a polynomial in its
bytes modulo 2**64, with a random number for each byte, stirred. So all words of a batch are
hashed at once, from running sums over the bytes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SHINGLE = 5

#: Bytes that are hashed at a time, at least a word.
AT_ONCE = 1 << 20

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
LETTERS = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype=np.uint64)

#: White space: the bytes, and other characters, which are made spaces first.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
ODD_SPACE = "[" + "".join(f"\\x{{{c:x}}}" for c in range(0x3001) if chr(c).isspace() and not (c < 128 and SPACE[c])) + "]"
LINE_BREAK, SENTENCE_ENDS = 10, np.isin(np.arange(256), list(b".!?"))


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes with all bits stirred."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


AHEAD, BACK = powers(BASE, AT_ONCE + 1), powers(INVERSE, AT_ONCE + 1)


def polynomial(letters: np.ndarray) -> np.uint64:
    """The hash of one word, before it is stirred, a part at a time."""
    out, by = 0, 1
    for k in range(0, len(letters), AT_ONCE):
        part = LETTERS[letters[k : k + AT_ONCE]]
        out += int((part * AHEAD[: len(part)]).sum(dtype=np.uint64)) * by
        by = by * pow(int(BASE), len(part), 1 << 64) % (1 << 64)
    return np.uint64(out % (1 << 64))


@dataclass
class Words:
    """The words of several texts, one after the other: how many each text has, their hashes, and which of them end a line (before a line break, with the mark of a sentence's end, or with the text)."""

    counts: np.ndarray
    hashes: np.ndarray
    line_ends: np.ndarray


@dataclass
class Bounds:
    """Where the words of several texts stand in the bytes of all, and what Words has of them but the hashes. texts: the numbers of the bytes with which each begins, and of all bytes."""

    counts: np.ndarray
    line_ends: np.ndarray
    data: np.ndarray
    texts: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def points(self) -> tuple[np.ndarray, np.ndarray]:
        """With how many code points of its text before it each word begins, and how many each text has."""
        if not (self.data > 127).any():
            return self.first - np.repeat(self.texts[:-1], self.counts), np.diff(self.texts)
        before = np.zeros(len(self.data) + 1, np.int64)
        np.cumsum((self.data & 0xC0) != 0x80, out=before[1:])
        return before[self.first] - np.repeat(before[self.texts[:-1]], self.counts), np.diff(before[self.texts])


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of texts, and with which each begins, and the number of all."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def bounds_of(texts: pa.Array) -> Bounds:
    """Where the words of texts (null: none) are. White space of more bytes counts as one space, so code points are those of the texts."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    data, offsets = bytes_of(texts)
    if ((data > 127) | (data - np.uint8(28) < 4)).any() and pc.any(pc.match_substring_regex(texts, ODD_SPACE)).as_py():
        data, offsets = bytes_of(pc.replace_substring_regex(texts, ODD_SPACE, " "))
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Bounds(np.zeros(len(texts), np.int64), np.zeros(0, bool), data, offsets, none, none)
    space = SPACE[data]
    begins, ends = np.ones(n, bool), np.ones(n, bool)
    begins[1:], ends[:-1] = space[:-1], space[1:]
    begins[offsets[:-1][offsets[:-1] < n]] = True
    ends[offsets[1:][offsets[1:] > 0] - 1] = True
    first, last = np.flatnonzero(begins & ~space), np.flatnonzero(ends & ~space) + 1
    counts = np.diff(np.searchsorted(first, offsets))
    line_ends = SENTENCE_ENDS[data[last - 1]]
    line_ends[np.cumsum(counts)[counts > 0] - 1] = True
    breaks = np.flatnonzero(data == LINE_BREAK)
    before = np.searchsorted(last, breaks, "right") - 1
    line_ends[before[before >= 0]] = True
    return Bounds(counts, line_ends, data, offsets, first, last)


def words_of(texts: pa.Array) -> Words:
    """The words of texts (null: none)."""
    found = bounds_of(texts)
    data, first, last = found.data, found.first, found.last
    hashes, k = np.zeros(len(first), np.uint64), 0
    while k < len(first):
        stop = int(np.searchsorted(last, first[k] + AT_ONCE, "right"))
        if stop <= k:
            hashes[k] = polynomial(data[first[k] : last[k]])
            k += 1
            continue
        part = LETTERS[data[first[k] : last[stop - 1]]]
        part *= AHEAD[: len(part)]
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part, dtype=np.uint64)])
        a, b = first[k:stop] - first[k], last[k:stop] - first[k]
        hashes[k:stop] = (sums[b] - sums[a]) * BACK[a]
        k = stop
    return Words(found.counts, mixed(hashes), found.line_ends)


def shingles_of(words: Words, size: int = SHINGLE) -> list[np.ndarray]:
    """For each text, the sorted different hashes of its runs of size words; a text of fewer words is one run, one without words has none."""
    h, ends = words.hashes, np.cumsum(words.counts)
    n = len(h)
    runs = np.zeros(n, np.uint64)
    left = np.repeat(ends, words.counts) - np.arange(n)  # words from each on to the end of its text
    runs += np.minimum(left, size).astype(np.uint64)
    for k in range(size):
        inside = left > k
        runs = np.where(inside, runs * BASE + np.concatenate([h[k:], np.zeros(min(k, n), np.uint64)]), runs)
    runs = mixed(runs)
    return [np.unique(runs[e - c : max(e - size + 1, e - c + 1)]) if c else runs[:0] for c, e in zip(words.counts.tolist(), ends.tolist(), strict=True)]


def shingle_hashes(text: str, size: int = SHINGLE) -> np.ndarray:
    return shingles_of(words_of(pa.array([text])), size)[0]
