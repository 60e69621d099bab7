"""Token ids of a vocabulary file by the tokenizers library, with a table of stretches that were encoded before.

A text is cut at white space that is always a border between the pieces that the vocabulary's
pattern makes, so the ids of a text are those of its stretches, one after the other. The
stretches of a batch are numbered by pyarrow; each different one is looked up in a bounded
table, and the library encodes those that aren't there: its model alone if a stretch is a word
of Latin letters with perhaps marks behind it, whose pieces are plain, and else its whole chain
of steps. Texts in which the file's added tokens stand (such as "<|endoftext|>"), or white
space in a row where that tells what a border is, go to the library whole. The ids are the
library's own, in its default setting: an added token's string is that token.
"""

from __future__ import annotations

import os
import re
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from .common import ranges

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark deals the work to the cores

#: Entries of a table of stretches; when it has more, it becomes the older table, from which what is used again comes back.
MOST = 150_000
#: Characters of texts that are cut at a time, and stretches whose ids are put together at a time.
AT_A_TIME, GATHERED = 1 << 22, 1 << 19

NONE = np.zeros(0, "<u4")

#: Words of ASCII and other Latin letters (U+00AA and U+00BA apart), a space before them or not, and ASCII marks but the apostrophe behind them. Unicode's later versions say nothing else of these.
PLAIN = re.compile(r"( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def byte_letters() -> dict[int, str]:
    """Byte -> letter of the vocabulary file: printable Latin-1 letters stand for themselves, the other bytes for letters from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


LETTERS = byte_letters()


class Encoder:
    """What both ways of cutting have in common."""

    def __init__(self, library: Tokenizer) -> None:
        self.library, self.table, self.older = library, {}, {}
        self.pieces = library.model.tokenize
        self.added = [t.content for t in library.get_added_tokens_decoder().values()]

    def direct(self, text: str) -> np.ndarray:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def apart(self, texts: pa.Array) -> pa.Array:
        """Which texts go to the library whole."""
        out = pa.array(np.zeros(len(texts), bool))
        for token in self.added:
            out = pc.or_(out, pc.match_substring(texts, token))
        return out

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Where each text's stretches begin, the number of each stretch, and the different stretches."""
        raise NotImplementedError

    def low(self, word: str) -> str:
        """A plain word as the library's normalizer leaves it."""
        return word

    def made(self, stretch: str) -> bytes:
        """The ids of a stretch."""
        if (plain := PLAIN(stretch)) is None:
            return self.direct(stretch).tobytes()
        word, marks = plain.groups()
        if marks:
            return self.known(word) + self.known(marks)
        if (low := self.low(word)) != word:
            return self.known(low)
        spelt = word.replace(" ", LETTERS[32]) if word.isascii() else word.encode().decode("latin-1").translate(LETTERS)
        ids = [t.id for t in self.pieces(spelt)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def known(self, stretch: str) -> bytes:
        """The ids of a stretch, from the table if they are there."""
        ids = self.table.get(stretch)
        if ids is None:
            ids = self.older.get(stretch)
            ids = self.table[stretch] = self.made(stretch) if ids is None else ids
        return ids

    def some(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        begins, number, stretches = self.cut(texts)
        if len(self.table) > MOST:
            self.older, self.table = self.table, {}
        ids_of = [*map(self.known, stretches)]
        length = np.fromiter(map(len, ids_of), np.int64, len(ids_of)) >> 2
        flat, start = np.frombuffer(b"".join(ids_of), "<u4"), np.cumsum(length) - length
        own = length[number]
        ends = np.concatenate([[0], np.cumsum(own)])
        parts = []
        for k in range(0, len(number), GATHERED):
            n = own[k : k + GATHERED]
            at = np.repeat(start[number[k : k + GATHERED]] - (np.cumsum(n) - n), n)
            at += np.arange(len(at))
            parts.append(flat[at])
        return (np.concatenate(parts) if parts else NONE), ends[begins[1:]]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (null: empty) as unsigned 32-bit integers, and where those of each text end."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return NONE, np.zeros(0, np.int64)
        apart = self.apart(texts)
        if pc.any(apart).as_py():
            rest = iter(split(*self.encode_all(texts.filter(pc.invert(apart)))))
            out = [self.direct(t.as_py()) if a else next(rest) for t, a in zip(texts, apart.to_pylist(), strict=True)]
            return np.concatenate([NONE, *out]), np.cumsum([len(x) for x in out])
        held, ends, at = [NONE], [], 0
        for first, last in ranges(texts, AT_A_TIME):
            ids, end = self.some(texts.slice(first, last - first))
            ends.append(end + at)
            held.append(ids)
            at += len(ids)
        return np.concatenate(held), np.concatenate(ends)

    def encode(self, text: str) -> bytes:
        """Ids of one text as little-endian unsigned 32-bit integers."""
        return self.encode_all(pa.array([text], pa.string()))[0].tobytes()


def split(ids: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    return np.split(ids, ends[:-1]) if len(ends) else []


def numbered(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Offsets of lists of strings, the number of each string, and the different strings."""
    found = lists.flatten().dictionary_encode()
    return lists.offsets.to_numpy() - lists.offsets[0].as_py(), found.indices.to_numpy(), found.dictionary.to_numpy(zero_copy_only=False).tolist()


class ByteLevel(Encoder):
    """Pieces take the space before them; of more white space in a row, all but the last are a piece. So one white space behind other characters is a border; a line break stays with the stretch behind it."""

    def apart(self, texts: pa.Array) -> pa.Array:
        return pc.or_(super().apart(texts), pc.match_substring_regex(texts, r"[\s\x0b\x{85}\p{Z}]{2}"))

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        begins, number, words = numbered(pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " "))
        first, several = begins[:-1], len(words)
        # the first stretch of a text has no space before it, nor have those that begin with a line break
        heads, at = np.unique(number[first], return_inverse=True)
        number = number.copy()
        number[first] = several + at
        return begins, number, [*(w if w[:1] == "\n" else f" {w}" for w in words), *(words[k] for k in heads)]

    def made(self, stretch: str) -> bytes:
        if stretch[:1] != "\n" or stretch == "\n":
            return super().made(stretch)
        return self.known("\n") + self.known(stretch[1:])


class WordEnds(Encoder):
    """White space is dropped and always a border."""

    def low(self, word: str) -> str:
        return word.lower()

    def cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, list[str]]:
        return numbered(pc.ascii_split_whitespace(texts))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The encoder for a vocabulary file; one of each in a process."""
    library = Tokenizer.from_file(path)
    return (WordEnds if library.model.end_of_word_suffix else ByteLevel)(library)
