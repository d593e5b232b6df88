"""Ids of whole texts by the tokenizers library, each distinct word of a group of texts looked up once.

White space always ends a word of the vocabulary's pattern, so a text's ids are its words' ids in a row. Texts are cut into words
and the words numbered by column; words that are not remembered yet go to the library in long rows, whose ids are cut at the
tokens that end a word.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tenora.llm.bpe import PRETOKEN, WORD_END
from tenora.llm.shingles import mixed

CONTROL = "\x1c\x1d\x1e\x1f"  # white space to the splitting function, none to the vocabulary's pattern
REMEMBERED = 48 << 20  # bytes of remembered words in a worker
LONG = 64  # words of more bytes are not remembered
GROUP = 1 << 20  # characters encoded together
ROW = 512  # words in a row for the library

_RANDOM = np.random.default_rng(20240301)
_VALUES = _RANDOM.integers(1, 1 << 63, (2, 256), np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = np.cumprod(np.where(np.arange(LONG + 1) > 0, 0x9E3779B97F4A7C15, 1).astype(np.uint64))


def _named(words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of words by two sums over their bytes; 0 for words that are empty or too long to remember."""
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
    lengths = np.diff(offsets)
    fine = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    a, b = np.zeros(len(words), np.uint64), np.zeros(len(words), np.uint64)
    if len(fine):
        data = np.frombuffer(words.buffers()[2], np.uint8)
        n = lengths[fine]
        first = np.cumsum(n) - n
        place = np.arange(int(n.sum())) - np.repeat(first, n)
        letters = data[np.repeat(offsets[fine], n) + place]
        for out, values in zip((a, b), _VALUES, strict=True):
            out[fine] = mixed(np.add.reduceat(values[letters] * _POWERS[place], first)) | np.uint64(1)
    return a, b


class Known:
    """Words' names in ascending order, and where their ids stand."""

    def __init__(self):
        self.a, self.b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The place of each word, -1 for unknown ones."""
        if not len(self.a):
            return np.full(len(a), -1)
        at = np.minimum(np.searchsorted(self.a, a), len(self.a) - 1)
        return np.where((self.a[at] == a) & (self.b[at] == b), at, -1)

    def add(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        begin = np.cumsum(size) - size + len(self.ids)
        order = np.argsort(a, kind="stable")
        at = np.searchsorted(self.a, a[order])
        self.a, self.b = np.insert(self.a, at, a[order]), np.insert(self.b, at, b[order])
        self.begin, self.size = np.insert(self.begin, at, begin[order]), np.insert(self.size, at, size[order])
        self.ids = np.concatenate([self.ids, ids])

    def bytes(self) -> int:
        return 24 * len(self.a) + 4 * len(self.ids)


def gathered(ids: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of ``ids`` that start at ``begin``, one behind another."""
    ends = np.cumsum(size, dtype=np.int64)
    return ids[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(begin - (ends - size), size)]


class WordEncoder:
    """Remembers words up to ``limit`` bytes: when the newer half is full, what has not been met since the half before goes."""

    def __init__(self, path: str, limit: int = REMEMBERED):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # workers are forked, and each has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for s, i in vocab.items() if s.endswith(WORD_END)]] = True
        self.half = limit // 2
        self.new, self.old = Known(), Known()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers; null counts as empty."""
        out: list[bytes] = []
        for group in _groups(texts):
            if len(group) == 1 and len(group[0]) > GROUP:
                out.append(b"".join(self._group([part])[0] for part in _parts(group[0])))
            else:
                out += self._group(group)
        return out

    def _group(self, texts: list[str]) -> list[bytes]:
        plain, apart = [], {}
        for i, text in enumerate(texts):
            if "<|" in text or any(c in text for c in CONTROL):
                apart[i] = np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                text = ""
            elif not text.isascii():
                # characters are lower-cased one by one, so a final sigma is no other letter
                text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
            plain.append(text.lower())
        words = pc.utf8_split_whitespace(pa.array(plain, pa.large_string()))
        numbered = words.flatten().dictionary_encode()
        begin, size, ids = self._lookup(numbered.dictionary)
        place = numbered.indices.to_numpy()
        row = gathered(ids, begin[place], size[place]).tobytes()
        last = np.concatenate([[0], np.cumsum(size[place])])[words.offsets.to_numpy() - words.offsets[0].as_py()] * 4
        return [apart[i] if i in apart else row[last[i] : last[i + 1]] for i in range(len(texts))]

    def _lookup(self, words: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct word's ids begin, how many they are, and the ids."""
        a, b = _named(words)
        lasting = a != 0
        old = np.where(lasting & (self.new.find(a, b) < 0), self.old.find(a, b), -1)
        kept = np.flatnonzero(old >= 0)
        if len(kept):
            size = self.old.size[old[kept]]
            self.new.add(a[kept], b[kept], size, gathered(self.old.ids, self.old.begin[old[kept]], size))
        at = np.where(lasting, self.new.find(a, b), -1)
        unknown = np.flatnonzero(at < 0)
        fresh, sizes = self._asked(words.take(pa.array(unknown)).to_pylist())
        begin, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = np.flatnonzero(at >= 0)
        begin[known], size[known] = self.new.begin[at[known]], self.new.size[at[known]]
        begin[unknown], size[unknown] = len(self.new.ids) + np.cumsum(sizes) - sizes, sizes
        ids = np.concatenate([self.new.ids, fresh])
        stay = lasting[unknown]
        if stay.any():
            self.new.add(a[unknown][stay], b[unknown][stay], sizes[stay], gathered(fresh, (np.cumsum(sizes) - sizes)[stay], sizes[stay]))
        if self.new.bytes() > self.half:
            self.new, self.old = Known(), self.new
        return begin, size, ids

    def _asked(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The library's ids of ``words`` in a row, and how many each has."""
        rows = [words[i : i + ROW] for i in range(0, len(words), ROW)]
        ids, sizes = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for row, found in zip(rows, self.library.encode_batch_fast([" ".join(r) for r in rows], add_special_tokens=False), strict=True):
            some = np.array(found.ids, "<u4")
            parts = np.array([1 if w.isalpha() else len(PRETOKEN.findall(w)) for w in row])
            ends = np.flatnonzero(self.ends[some]) + 1
            if len(ends) == parts.sum() and (not len(some) or ends[-1] == len(some)):
                sizes.append(np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(parts)])]))
                ids.append(some)
            else:  # the pattern's tables and the library's disagree on a letter
                each = [np.array(x.ids, "<u4") for x in self.library.encode_batch_fast(row, add_special_tokens=False)]
                sizes.append(np.array([len(x) for x in each]))
                ids += each
        return np.concatenate(ids), np.concatenate(sizes)


def _groups(texts: list[str | None]) -> Iterator[list[str]]:
    """``texts`` in groups of about GROUP characters; a longer text is a group of its own."""
    held, size = [], 0
    for text in texts:
        text = text or ""
        if held and size + len(text) > GROUP:
            yield held
            held, size = [], 0
        held.append(text)
        size += len(text)
    if held:
        yield held


def _parts(text: str) -> Iterator[str]:
    """A long text in parts that end at a space; one part if it is not cut at all."""
    if "<|" in text or any(c in text for c in CONTROL):
        yield text
        return
    at = 0
    while at < len(text):
        cut = text.find(" ", at + GROUP)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut]
        at = cut


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch in slices of about GROUP bytes of one text column, a row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + GROUP, "right")))
        yield batch.slice(at, stop - at)
        at = stop


@lru_cache(maxsize=2)
def word_encoder(path: str) -> WordEncoder:
    """One encoder for each file and Python worker."""
    return WordEncoder(path)
