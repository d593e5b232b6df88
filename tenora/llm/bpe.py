"""Operator 3: BPE encoding by a bounded-lookahead streaming transducer, and incremental decoding.

Every prefix of a symbol string has one BPE encoding, and cutting an encoding after any of its tokens leaves the
encoding of what stands before the cut. So it is enough to know, for each place, the last token of the encoding of the
prefix that ends there: it is the one token that ends there, fits behind the last token of the shorter prefix, and would
not have been merged with it. Later tokens can only start at the last ``longest`` places; once the
chains of tokens that lead to all of these share their beginning, that beginning is final and is emitted. The merge list
gives an upper bound (``lookahead``) for how long that can take, so memory doesn't grow with the text.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

INF = 1 << 60
WORD_END = "</w>"

#: Fixed value: the pattern of the vocabulary file's pre-tokenizer.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    spare = (b for b in range(256) if b not in table)
    table |= {b: chr(256 + i) for i, b in enumerate(spare)}
    return [table[b] for b in range(256)]


class Merges:
    """A vocabulary and its merge list: which tokens may stand side by side in an encoding."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in spec["model"]["merges"]]
        self.text = {i: s for s, i in (self.vocab | self.special).items()}
        ids = [(self.vocab[a], self.vocab[b], self.vocab[a + b]) for a, b in pairs]
        self.rank = {(a, b): r for r, (a, b, _) in reversed([*enumerate(ids)])}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, (a, b, made) in enumerate(ids):
            self.parts.setdefault(made, (a, b, r))
        self.longest = max(len(s.removesuffix(WORD_END)) for s in self.vocab)
        self.prefixes = {s[:k] for s in self.vocab for k in range(1, len(s) + 1)}
        self._right: dict[int, list[tuple[int, int]]] = {}
        self._left: dict[int, list[tuple[int, int]]] = {}
        self.fits_known: dict[int, bool] = {}
        self.whole_known: dict[int, bool] = {}
        self.length = [len(self.text[i].removesuffix(WORD_END)) for i in range(len(self.text))]

    @property
    def lookahead(self) -> int:
        """Symbols after which every token before is final: a token's fate hangs on a chain of merges, each of a higher rank.

        A chain has at most as many links as tokens nest along one edge, and each link spans one token.
        """
        deepest = max(len(self._spine(t, side)) for t in self.parts for side in (0, 1))
        return self.longest * (deepest + 1)

    def _spine(self, token: int, side: int) -> list[tuple[int, int]]:
        """The tokens along the left (0) or right (1) edge of ``token``, from the symbol up, each with the rank that ends it."""
        cache = self._right if side else self._left
        if token not in cache:
            steps, ends, t = [], INF, token
            while True:
                steps.append((t, ends))
                if t not in self.parts:
                    break
                ends, t = self.parts[t][2], self.parts[t][side]
            cache[token] = steps[::-1]
        return cache[token]

    def fit(self, a: int, b: int, below: int = INF) -> bool:
        """Would a merge of rank under ``below`` never join the end of ``a`` to the beginning of ``b``?

        Both are built up at once, lowest rank first; on equal ranks the left one is first, as merges run from the left.
        """
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            r = self.rank.get((x, y), INF)
            if r < below and r < x_ends and r <= y_ends:
                return False
            if x_ends >= INF and y_ends >= INF:
                return True
            if x_ends <= y_ends:
                i += 1
            else:
                j += 1

    def fits(self, a: int, b: int) -> bool:
        """Can ``a`` be followed by ``b``? Both must be whole."""
        key = a << 20 | b
        known = self.fits_known.get(key)
        if known is None:
            if len(self.fits_known) > 1_000_000:
                self.fits_known.clear()
            known = self.fits_known[key] = self.whole(b) and self.fit(a, b)
        return known

    def whole(self, token: int) -> bool:
        """Is the token its own encoding?"""
        known = self.whole_known.get(token)
        if known is None:
            if token not in self.parts:
                known = True
            else:
                a, b, r = self.parts[token]
                known = self.whole(a) and self.whole(b) and self.fit(a, b, r)
            self.whole_known[token] = known
        return known


class Transducer:
    """Symbols in, token ids out: one word at a time, ``longest`` places of state besides what isn't final yet."""

    def __init__(self, merges: Merges):
        self.m = merges
        self.most_held = 0
        self.beginnings: dict[str, int] = {}

    def encode_short(self, s: str) -> list[int]:
        """The ids of one word that fits into the state. The last tokens of beginnings are remembered over words."""
        out, at, end = [], len(s), WORD_END
        while at:
            token = self._last_of(s[:at], end)
            out.append(token)
            at -= self.m.length[token]
            end = ""
        out.reverse()
        return out

    def _last_of(self, s: str, end: str) -> int:
        """The last token of the encoding of ``s``, which is a whole word if ``end`` is the word-end mark."""
        known = self.beginnings
        token = None if end else known.get(s)
        if token is not None:
            return token
        m, at = self.m, len(s)
        get, fits = m.vocab.get, m.fits_known
        for start in range(at - m.longest if at > m.longest else 0, at):
            token = get(s[start:] + end)
            if token is None:
                continue
            if start:
                prior = known.get(s[:start])
                if prior is None:
                    prior = self._last_of(s[:start], "")
                ok = fits.get(prior << 20 | token)
                if ok is None:
                    ok = m.fits(prior, token)
            else:
                ok = m.whole(token)
            if ok:
                if not end:
                    if len(known) >= 300_000:
                        known.clear()
                    known[s] = token
                return token
        raise ValueError("a symbol is not in the vocabulary")

    def encode(self, symbols: Iterable[str]) -> Iterator[int]:
        """The ids of one word, given in pieces of symbols; the last symbol gets the word-end mark."""
        m, held, last, base = self.m, "", {0: -1}, 0
        # held: symbols from place base on; last: place -> last token of the prefix that ends there
        for piece in symbols:
            if not piece:
                continue
            start = base + len(held)
            held += piece
            # the newest symbol waits, as it may be the word's last
            self._advance(held, last, base, start - 1 if start > base else base, base + len(held) - 1)
            if len(held) > 4 * m.longest:
                ids, base2 = self._stable(held, last, base)
                held, base = held[base2 - base :], base2
                yield from ids
            self.most_held = max(self.most_held, len(held))
        if held:
            end = base + len(held)
            found = self._ending(held, last, base, end, True)
            yield from self._chain(held, last, base, end, found)

    def _ending(self, held: str, last: dict[int, int], base: int, at: int, final: bool) -> int:
        """The last token of the prefix that ends at ``at``."""
        m, vocab = self.m, self.m.vocab
        for k in range(min(m.longest, at - base), 0, -1):
            prior = last.get(at - k)
            if prior is None:
                continue
            text = held[at - k - base : at - base]
            token = vocab.get(text + WORD_END if final else text)
            if token is not None and (m.whole(token) if prior < 0 else m.fits(prior, token)):
                return token
        raise ValueError("a symbol is not in the vocabulary")

    def _advance(self, held: str, last: dict[int, int], base: int, start: int, end: int) -> None:
        for at in range(start + 1, end + 1):
            if at not in last:
                last[at] = self._ending(held, last, base, at, False)

    def _chain(self, held: str, last: dict[int, int], base: int, at: int, token: int) -> list[int]:
        out = [token]
        at -= self.m.length[token]
        while at > base:
            token = last[at]
            out.append(token)
            at -= self.m.length[token]
        return out[::-1]

    def _stable(self, held: str, last: dict[int, int], base: int) -> tuple[list[int], int]:
        """The tokens that the chains to all of the latest places share, and the place where they end."""
        newest = base + len(held) - 1
        heads = {at for at in range(max(base, newest - self.m.longest), newest + 1) if at in last}
        while len(heads) > 1:  # step the furthest back, until all meet
            far = max(heads)
            heads.remove(far)
            heads.add(max(base, far - self.m.length[last[far]]))
        meet = heads.pop()
        if meet <= base:
            return [], base
        ids = self._chain(held, last, base, meet, last[meet]) if meet > base else []
        for at in [at for at in last if at < meet]:
            del last[at]
        return ids, meet


class Tokenizer:
    """Text to ids as the tokenizers library gives them without special-token insertion, and ids to its decoded text.

    Words are remembered up to ``cache`` of them; longer ones than 64 characters are streamed and never remembered.
    """

    def __init__(self, path: str, cache: int = 600_000):
        self.merges = Merges(path)
        self.transducer = Transducer(self.merges)
        self.symbol = byte_symbols()
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, self.merges.special)) + ")")
        owner = self

        class Words(dict):
            def __missing__(self, word: str) -> bytes:
                ids = owner._word(word)
                if len(word) <= 64:
                    if len(self) >= cache:
                        self.clear()
                    self[word] = ids
                return ids

        self.words = Words()

    def _word(self, word: str) -> bytes:
        """Ids of text without white space, as little-endian unsigned 32-bit integers."""
        out: list[int] = []
        for part in PRETOKEN.finditer(word):
            start, end = part.span()
            if end - start <= 32:
                out += self.transducer.encode_short("".join([self.symbol[b] for b in word[start:end].encode("utf-8", "replace")]))
            else:
                out.extend(self.transducer.encode(self._symbols(word, start, end)))
        return np.array(out, "<u4").tobytes()

    def _symbols(self, word: str, start: int, end: int, step: int = 256) -> Iterator[str]:
        symbol = self.symbol
        for at in range(start, end, step):
            yield "".join([symbol[b] for b in word[at : min(end, at + step)].encode("utf-8", "replace")])

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as bytes."""
        if "<|" not in text:
            return self._plain(text)
        out = []
        for i, part in enumerate(self.split_special.split(text)):
            out.append(np.array([self.merges.special[part]], "<u4").tobytes() if i % 2 else self._plain(part))
        return b"".join(out)

    def _plain(self, text: str) -> bytes:
        if not text.isascii():
            # characters are lower-cased one by one, so a final sigma is no other letter
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        words = SPACE.split(text) if any(c in text for c in CONTROL) else text.split()
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text."""
        machine = Decoder(self.merges)
        return machine.feed(np.frombuffer(ids, "<u4")) + machine.close()


#: str.split() also cuts at these, which are no white space to the vocabulary's patterns.
CONTROL = "\x1c\x1d\x1e\x1f"
SPACE = regex.compile(r"[^\S\x1c-\x1f]+")


class Decoder:
    """Ids in, bytes out: the tokens' surface strings joined by one space, as a vocabulary without a decoder has it.

    The only state is whether a token went before, so ids may come in pieces of any size.
    """

    def __init__(self, merges: Merges):
        if not hasattr(merges, "surface"):
            merges.surface = [merges.text[i].encode() for i in range(len(merges.text))]
        self.surface = merges.surface
        self.begun = False

    def feed(self, ids: np.ndarray) -> bytes:
        if not len(ids):
            return b""
        text = b" ".join(map(self.surface.__getitem__, ids.tolist()))
        text = b" " + text if self.begun else text
        self.begun = True
        return text

    def close(self) -> bytes:
        return b""


class ByteDecoder:
    """Ids of a byte-level vocabulary in, UTF-8 of the text out.

    A character's bytes may lie in several tokens: those of an unfinished one, three at most, are the only state, so ids may come
    in pieces of any size. Bytes that belong to no character become U+FFFD, an unfinished end when the machine is closed.
    Ids that the vocabulary does not have are left out.
    """

    def __init__(self, pieces: dict[int, bytes]):
        self.pieces = pieces
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> bytes:
        return self.machine.decode(b"".join([self.pieces.get(i, b"") for i in ids.tolist()])).encode()

    def close(self) -> bytes:
        return self.machine.decode(b"", True).encode()


@lru_cache(maxsize=2)
def byte_pieces(path: str) -> dict[int, bytes] | None:
    """The bytes of each id of a byte-level vocabulary; None for other vocabularies.

    Such a vocabulary writes printable bytes as the characters of their numbers, and the others, in turn, as those from 256 on.
    """
    kept = json.loads(Path(path).read_text(encoding="utf-8"))
    if (kept.get("decoder") or {}).get("type") != "ByteLevel":
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte_of = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}
    tokens = {i: t for t, i in kept["model"]["vocab"].items()} | {t["id"]: t["content"] for t in kept.get("added_tokens") or ()}
    return {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for i, t in tokens.items()}


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One tokenizer for each file and Python worker."""
    return Tokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])


def encode_batches(path: str, end_id: int | None = None):
    """For mapInArrow over (doc_id, text): doc_id, n_tokens, ids as little-endian unsigned 32-bit integers, ``end_id`` at the end."""
    tail = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [tok.encode(x or "") + tail for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, path: str | None = None, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids. Null and empty texts have no ids (but ``end_id``, if given).

    Rows are handled one by one without a shuffle; a text of any length needs its ids' memory only. Only the two columns
    named are read.
    """
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(encode_batches(path or default_path(), end_id), SCHEMA)


def decode_documents(tokens: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and decoded text of rows (doc_id, ids); null and empty ids give an empty text. Byte-level vocabularies are decoded too."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = byte_pieces(path)

        def decode(ids: bytes) -> bytes:
            if pieces is None:
                return tokenizer(path).decode(ids)
            machine = ByteDecoder(pieces)
            return machine.feed(np.frombuffer(ids, "<u4")) + machine.close()

        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = [decode(x or b"").decode("utf-8", "replace") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids again, and digest both in the same task, so that neither is shuffled."""
    path = default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)
        for batch in batches:
            ids = [tok.encode(x or "") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(tok.decode(x)).hexdigest() for x in ids]), pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids_crc32"],
            )

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids_crc32 long")
