"""Encoding to and decoding from a SentencePiece BPE model, in rounds of vectorised merges."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sealane.llm.common import documents

#: What stands for a blank in pieces.
BLANK = "▁"
#: Characters of text that are segmented together; a longer text is taken alone and whole.
CHUNK = 1 << 20
#: Characters of the distinct words that a worker remembers before it starts anew.
REMEMBERED = 8 << 20
#: Rounds after which the few words that are still open (long runs of blanks) are merged one pair at a time.
ROUNDS = 256
#: Symbols that a merge round holds at once, so that arrays stay small.
SYMBOLS = 1 << 20

codecs.register_error("one-mark-a-byte", lambda fault: ("\ufffd", fault.start + 1))

_CODES = 0x110000
_NONE = np.iinfo(np.int32).max

# Fields of the model's protocol buffer and its kinds of pieces.
_PIECE, _TRAINER, _NORMALIZER = 1, 2, 3
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_UNKNOWN_SURFACE = " \u2047 "


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            value |= (data[at] & 127) << shift
            shift, at = shift + 7, at + 1
            if data[at - 1] < 128:
                return value, at

    at = 0
    while at < len(data):
        key, at = number(at)
        if key & 7 == 0:
            value, at = number(at)
        else:
            if key & 7 == 2:
                size, at = number(at)
            else:
                size = {1: 8, 5: 4}[key & 7]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class Model:
    """The pieces of a BPE model file and the ranks of their merges.

    A symbol is a piece's id or, for a character that is no piece, the number of pieces plus its code
    point.  ``keys`` are the pairs of symbols that make a piece, sorted; ``rank`` orders merges (equal
    scores share a rank) and ``made`` is the piece.  A piece is ``calm`` if none that begins or ends
    with it has a rank as low as its own: then its merges in a word cannot get in each other's way.
    """

    def __init__(self, path: str) -> None:
        with open(path, "rb") as file:
            data = file.read()
        pieces, bpe, plain, prefixed, unknown = [], False, True, True, _UNKNOWN_SURFACE
        for field, value in _fields(data):
            if field == _PIECE:
                got = {1: b"", 2: b"\0\0\0\0", 3: _NORMAL} | dict(_fields(value))
                pieces.append((got[1].decode(), struct.unpack("<f", got[2])[0], got[3]))
            elif field == _TRAINER:
                got = dict(_fields(value))
                bpe, unknown = got.get(3) == 2 and bool(got.get(35)), got.get(44, b"").decode() or _UNKNOWN_SURFACE
            elif field == _NORMALIZER:
                got = dict(_fields(value))
                plain, prefixed = not got.get(2) and not got.get(4, 1) and bool(got.get(5, 1)), bool(got.get(3, 1))
        kinds = {kind for _, _, kind in pieces} - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}
        if not (bpe and plain and prefixed) or kinds:
            raise ValueError("only BPE models with byte fallback, a dummy prefix, no normalisation and no pieces of the user's are known")
        self.n = len(pieces)
        self.text = [{_UNKNOWN: unknown, _CONTROL: ""}.get(kind, p) for p, _, kind in pieces]
        self.id = {p: k for k, (p, _, kind) in enumerate(pieces) if kind == _NORMAL}
        self.byte = [k for k, (_, _, kind) in enumerate(pieces) if kind == _BYTE]
        if len(self.byte) != 256 or BLANK not in self.id:
            raise ValueError("the model lacks byte pieces or the blank")
        if any(re.search(f"[^{BLANK}]{BLANK}", p) for p in self.id):
            raise ValueError("a piece goes on after a blank, so words are not apart")
        scores = sorted({score for _, score, kind in pieces if kind == _NORMAL}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        rank_of = {k: place[score] for k, (_, score, kind) in enumerate(pieces) if kind == _NORMAL}
        rows = []
        for piece, k in self.id.items():
            for cut in range(1, len(piece)):
                left, right = self._symbol(piece[:cut]), self._symbol(piece[cut:])
                if left is not None and right is not None:
                    rows.append((left * (self.n + _CODES) + right, rank_of[k], k, left, right))
        table = np.asarray(sorted(rows), np.int64).reshape(-1, 5)
        self.keys, self.rank, self.made = np.ascontiguousarray(table[:, 0]), table[:, 1].astype(np.int32), np.ascontiguousarray(table[:, 2])
        self.calm = np.ones(self.n, bool)
        own = np.full(self.n + _CODES, -1)
        own[list(rank_of)] = list(rank_of.values())
        for side in (3, 4):
            part = table[:, side]
            hasty = part[(table[:, 1] <= own[part])]
            self.calm[hasty[hasty < self.n]] = False
        chars = np.arange(_CODES, dtype=np.int64) + self.n
        for piece, k in self.id.items():
            if len(piece) == 1:
                chars[ord(piece)] = k
        self.first = chars

    def _symbol(self, piece: str) -> int | None:
        return self.id.get(piece, self.n + ord(piece) if len(piece) == 1 else None)

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, piece made) of each pair of symbols; _NONE if it makes none."""
        keys = left * (self.n + _CODES) + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        found = self.keys[at] == keys
        return np.where(found, self.rank[at], _NONE).astype(np.int32), np.where(found, self.made[at], -1)

    def merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all words, n + 1 offsets): what is left of each word's characters after all merges.

        A merge takes the pair of the lowest rank in a word, the leftmost of several.  A round takes
        that of every word at once, and all places of it that do not overlap if the piece is calm.
        """
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol = self.first[codes]
        rank, made = self._beside(symbol, word)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        for _ in range(ROUNDS):
            if not len(symbol):
                break
            start = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[start, len(word)])
            least = np.minimum.reduceat(rank, start)
            ended = np.repeat(least == _NONE, size)
            if ended.any():  # words without a pair leave
                done.append((word[ended], symbol[ended]))
                word, symbol, rank, made = (x[~ended] for x in (word, symbol, rank, made))
                least, size = least[least != _NONE], size[least != _NONE]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            taken = self._apart(at, word[at], self.calm[made[at]])
            symbol[taken] = made[taken]
            keep = np.ones(len(symbol), bool)
            keep[taken + 1] = False
            new = (np.cumsum(keep) - 1)[taken]
            word, symbol, rank, made = (x[keep] for x in (word, symbol, rank, made))
            again = np.unique(np.r_[new, new[new > 0] - 1])
            self._refresh(again, symbol, word, rank, made)
        if len(symbol):
            done.append(self._one_by_one(word, symbol))
        word, symbol = (np.concatenate(x) if done else np.empty(0, np.int64) for x in (list(zip(*done, strict=True)) if done else ((), ())))
        order = np.argsort(word, kind="stable")
        return symbol[order], np.searchsorted(word[order], np.arange(len(words) + 1))

    def _beside(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, made = np.full(len(symbol), _NONE, np.int32), np.full(len(symbol), -1)
        self._refresh(np.arange(len(symbol)), symbol, word, rank, made)
        return rank, made

    def _refresh(self, at: np.ndarray, symbol: np.ndarray, word: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Set rank and made of the pairs that begin at ``at``."""
        rank[at], made[at] = _NONE, -1
        at = at[at + 1 < len(symbol)]
        at = at[word[at] == word[at + 1]]
        rank[at], made[at] = self.pairs(symbol[at], symbol[at + 1])

    @staticmethod
    def _apart(at: np.ndarray, word: np.ndarray, calm: np.ndarray) -> np.ndarray:
        """Of the places of the lowest pair: every other of those side by side; only a word's first if the piece is not calm."""
        first = np.r_[True, word[1:] != word[:-1]]
        run = first | np.r_[True, at[1:] != at[:-1] + 1]
        begin = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
        even = (np.arange(len(at)) - begin) % 2 == 0
        restless = np.logical_or.reduceat(~calm, np.flatnonzero(first))[np.cumsum(first) - 1]
        return at[np.where(restless, first, even)]

    def _one_by_one(self, word: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same merges from a heap, for words that need many rounds."""
        table = {k: (r, m) for k, r, m in zip(self.keys.tolist(), self.rank.tolist(), self.made.tolist(), strict=True)}
        s, w, n = symbol.tolist(), word.tolist(), len(symbol)
        after, before, heap = list(range(1, n + 1)), list(range(-1, n - 1)), []

        def look(a: int) -> None:
            b = after[a]
            if b < n and w[a] == w[b] and (found := table.get(s[a] * (self.n + _CODES) + s[b])):
                heapq.heappush(heap, (found[0], a, b, s[a], s[b], found[1]))

        for a in range(n - 1):
            look(a)
        while heap:
            _, a, b, left, right, made = heapq.heappop(heap)
            if s[a] != left or s[b] != right or after[a] != b:
                continue
            s[a], s[b], after[a] = made, -1, after[b]
            if after[b] < n:
                before[after[b]] = a
            if before[a] >= 0:
                look(before[a])
            look(a)
        left = np.asarray(s) >= 0
        return word[left], np.asarray(s)[left]

    def ids(self, symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols with those of characters that are no pieces written as their UTF-8 bytes."""
        loose = symbols >= self.n
        if not loose.any():
            return symbols, offsets
        code = symbols[loose] - self.n
        size = np.ones(len(symbols), np.int64)
        size[loose] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        place = np.r_[0, np.cumsum(size)]
        out = np.repeat(symbols, size)
        raw = np.frombuffer("".join(map(chr, code.tolist())).encode(), np.uint8)
        out[np.repeat(loose, size)] = np.asarray(self.byte)[raw]
        return out, place[offsets]

    def surface(self, ids: list[int]) -> str:
        """Text of a word's ids: pieces with blanks, runs of byte pieces as UTF-8, U+FFFD for each byte that is none."""
        out, raw = [], bytearray()
        low = self.byte[0]
        for k in ids:
            if low <= k <= low + 255:
                raw.append(k - low)
                continue
            if raw:
                out.append(raw.decode("utf-8", "one-mark-a-byte"))
                raw.clear()
            out.append(self.text[k].replace(BLANK, " "))
        return "".join(out) + raw.decode("utf-8", "one-mark-a-byte")


@lru_cache(maxsize=1)  # a worker is used for many tasks
def model(path: str) -> Model:
    return Model(path)


class Words:
    """(number of ids, ids joined by commas, surface) of words, each distinct one worked out once while remembered."""

    pattern = re.compile(f"{BLANK}+[^{BLANK}]*")

    def __init__(self, path: str) -> None:
        self.model, self.known, self.held = model(path), {}, 0

    def split(self, text: str) -> list[str]:
        """The words of a text, each with the blanks before it; no piece reaches from one into the next."""
        return self.pattern.findall(BLANK + text.replace(" ", BLANK)) if text else []

    def learn(self, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.known]
        if self.held > REMEMBERED:
            self.known, self.held, fresh = {}, 0, list(words)
        a = 0
        while a < len(fresh):
            b, size = a, 0
            while b < len(fresh) and (b == a or size + len(fresh[b]) <= SYMBOLS):
                size, b = size + len(fresh[b]), b + 1
            ids, offsets = self.model.ids(*self.model.merged(fresh[a:b]))
            ids, offsets = ids.tolist(), offsets.tolist()
            for w, i, j in zip(fresh[a:b], offsets, offsets[1:], strict=False):
                self.known[w] = (j - i, ",".join(map(str, ids[i:j])), self.model.surface(ids[i:j]))
            a, self.held = b, self.held + size

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """(number of ids, ids joined by commas, decoded text) of each text."""
        a = 0
        while a < len(texts):
            b, size = a, 0
            while b < len(texts) and (b == a or size + len(texts[b]) <= CHUNK):
                size, b = size + len(texts[b]), b + 1
            split = [self.split(t) for t in texts[a:b]]
            self.learn(set().union(*split))
            for words in split:
                n, ids, surface = zip(*map(self.known.__getitem__, words), strict=True) if words else ((), (), ())
                decoded = "".join(surface)
                yield sum(n), ",".join(ids), decoded.removeprefix(" ")
            a = b


def encode_ids(text: str | None, path: str) -> list[int]:
    """All ids of one text."""
    (_, ids, _), = Words(path).encoded([text or ""])
    return [int(k) for k in ids.split(",")] if ids else []


def decode_ids(ids: list[int], path: str) -> str:
    """The text of any ids: the first piece loses its dummy blank, control pieces are silent."""
    m = model(path)
    text = m.surface(ids)
    first = next((k for k in ids if m.text[k]), None)
    return text.removeprefix(" ") if first is not None and m.id.get(m.text[first]) == first else text


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, n_chars_decoded), one row for each row of ``docs``.

    Ids are those of the sentencepiece library without begin and end ids; a null text is empty and has
    none.  Repeated rows get a row each and a null doc_id stays null.  Texts of any length are taken
    whole: memory follows the longest text and CHUNK.  Only doc_id and text are read, whatever the
    other columns' names.  An empty table gives an empty result.  No shuffle: each row stands for itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(path)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = [(n, sha(ids), sha(text), len(text)) for n, ids, text in words.encoded(texts)]
            columns = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(columns, kinds, strict=True)]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chars_decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, n_chars_decoded long")


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), model_path())
