"""Best-fit packing of tokenized documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sealane.llm.common import Shelf, documents

CAPACITY = 1024
END_ID = 2
#: Pieces that one task packs, on average; of these the emptiest sequences with one in TAIL are packed again with others'.
SHARD, TAIL = 60_000, 8

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
_PLACED = _PIECES + ", sequence_id long, offset long"

# Where byte-level BPE cuts a text, and the bytes that it writes as themselves; others are U+0100 and on.
_CUTS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_READ = {chr(b): b for b in _PRINTABLE} | {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


class Encoder:
    """Ids of whole texts, as little-endian uint32 bytes, by a byte-level BPE file of ``tokenizers``.

    Where a vocabulary's ids ascend in the order of its merges, as they do in the usual files, they
    are the ranks that tiktoken merges by, about three times as fast and with nothing remembered
    from text to text.  Other files, and texts with very long runs of white space, for which
    tiktoken's cuts run out of stack, are left to ``tokenizers``.  The ids are the same either way.
    """

    blank = re.compile(r"\s{20000}")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        with open(path, encoding="utf-8") as file:
            rules = json.load(file)
        vocabulary, self.quick = rules["model"].get("vocab"), None
        if self._ranked(rules):
            ranks = {bytes(map(_AS_READ.__getitem__, written)): k for written, k in vocabulary.items()}
            self.quick = tiktoken.Encoding(path, pat_str=_CUTS, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @staticmethod
    def _ranked(rules: dict) -> bool:
        """Whether ids are the order of the merges and nothing else changes or cuts the text."""
        model, cuts = rules["model"], rules["pre_tokenizer"] or {}
        if model["type"] != "BPE" or rules["normalizer"] or cuts.get("type") != "ByteLevel" or cuts["add_prefix_space"] or not cuts["use_regex"]:
            return False
        if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix")) or not all(_AS_READ.keys() >= set(w) for w in model["vocab"]):
            return False
        made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        return len(made) + 256 == len(model["vocab"]) and all(a < b for a, b in pairwise(made))

    def encode(self, text: str) -> bytes:
        if self.quick is None or (len(text) >= 20_000 and self.blank.search(text)):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.quick(text)).tobytes()


@lru_cache(maxsize=1)  # a worker is used for many tasks
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def cut(ids: bytes, capacity: int = CAPACITY) -> list[tuple[int, bytes]]:
    """(start, ids) of a document's pieces: one, or full ones after a first that may be shorter."""
    n = len(ids) // 4
    first = n if n <= capacity else n % capacity or capacity
    edges = [0, *range(first, n + 1, capacity)]
    return [(a, ids[4 * a : 4 * b]) for a, b in zip(edges, edges[1:], strict=False)]


def pieces(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document; a null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(tokenizer_path).encode, np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encode(text.as_py() or "") + end
                out += [(doc_id, k, start, len(part) // 4, zlib.crc32(part)) for k, (start, part) in enumerate(cut(ids))]
            if out:
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, _PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int = CAPACITY, sparing: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, taken in the order given.

    Each item goes where the sum over all residual gaps of the squared number of open bins with
    that gap becomes smallest, be it an open bin or a new one; among equal choices the tightest bin
    wins.  Empty and full bins count nothing.  With ``sparing`` a bin is opened only where no open
    one has room, whatever the squares.
    """
    count = np.zeros(capacity + 1, dtype=np.int64)  # open bins by gap; [0] and [capacity] stay 0
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    leave = np.full(capacity + 1, 1 << 40, dtype=np.int64)  # change of the sum when a bin leaves this gap
    leave[capacity] = 1 << 39 if sparing else 0  # a new bin
    enter = np.ones(capacity + 1, dtype=np.int64)  # and when one comes to it
    enter[0] = 0
    bins, offsets, n_bins = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0

    def note(gap: int, change: int) -> None:
        n = count[gap] = count[gap] + change
        leave[gap] = 1 - 2 * n if n else 1 << 40
        enter[gap] = 2 * n + 1

    for i, size in enumerate(lengths.tolist()):
        gap = size + int(np.argmin(leave[size:] + enter[: capacity + 1 - size]))
        if gap == capacity:
            at, n_bins = n_bins, n_bins + 1
        else:
            at = open_bins[gap].pop()
            note(gap, -1)
        bins[i], offsets[i] = at, capacity - gap
        if gap > size:
            open_bins[gap - size].append(at)
            note(gap - size, 1)
    return bins, offsets


def emptiest(bins: np.ndarray, lengths: np.ndarray, most: int, capacity: int = CAPACITY) -> np.ndarray:
    """Which items lie in the emptiest bins that are not full and have ``most`` items together."""
    fill, held = np.bincount(bins, lengths), np.bincount(bins)
    order = np.argsort(fill, kind="stable")
    again = np.zeros(len(fill), bool)
    again[order[(np.cumsum(held[order]) <= most) & (fill[order] < capacity)]] = True
    return again[bins]


def pack(docs: DataFrame, tokenizer_path: str, shard: int = SHARD) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every piece.

    Documents are encoded once and their pieces, without text, are written to the shared folder.
    Pieces are dealt to tasks by a hash of their row, so neither long documents nor hot sources nor
    repeated rows gather anywhere; each task packs about ``shard`` of them, longest first.  The
    emptiest sequences of all tasks are opened again and their pieces packed together, level by
    level, until one task holds the last of them, which opens a sequence only where it must.
    A null or empty text is one piece with the end id alone.  Repeated rows are packed once each.
    Only doc_id and text are read.  An empty table gives an empty result.
    """
    shelf = Shelf(docs.sparkSession)
    todo = shelf.put("pieces", pieces(docs, tokenizer_path).withColumn("_row", F.monotonically_increasing_id()))
    level, done = 0, []
    while True:
        n_shards = max(1, -(-todo.count() // shard))
        dealt = todo.withColumn("_shard", F.pmod(F.xxhash64("_row", F.lit(level)), F.lit(n_shards)).cast("int"))
        placed = shelf.put(f"level {level}", dealt.groupBy("_shard").applyInArrow(_place(level, n_shards == 1, shard), f"{_PLACED}, _row long, _again boolean"))
        done.append(placed.where("NOT _again").drop("_row", "_again"))
        if n_shards == 1:
            return reduce(DataFrame.unionByName, done)
        todo, level = placed.where("_again").select(*_PIECE_NAMES, "_row"), level + 1


_PIECE_NAMES = [part.split()[0] for part in _PIECES.split(", ")]


def _place(level: int, last: bool, shard: int):
    """What packs the pieces of one shard."""

    def place(group: pa.Table) -> pa.Table:
        group = group.take(pc.sort_indices(group, [("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("_row", "ascending")]))
        lengths = group["length"].to_numpy()
        bins, offsets = sum_of_squares(lengths, sparing=last)
        again = np.zeros(len(lengths), bool) if last else emptiest(bins, lengths, shard // TAIL)
        names = (level << 56) | (group["_shard"][0].as_py() << 32) | bins
        found = group.select(_PIECE_NAMES)
        for name, values in (("sequence_id", names), ("offset", offsets)):
            found = found.append_column(name, pa.array(values, pa.int64()))
        return found.append_column("_row", group["_row"]).append_column("_again", pa.array(again))

    return place


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())
