"""Best-fit packing of token sequences: best-two-fit.

Documents are tokenised, ended by one end id and cut into pieces of at most ``capacity``
tokens.  A bin is filled greedily (always the longest piece that fits the gap); then its
smallest piece is taken out if two unpacked pieces fill the gap that this leaves more tightly.

Pieces are dealt over shards by a hash of their place, each with about ``SHARD_PIECES``
pieces, and every shard is packed alone; a shard ends with at most a few bins that aren't
full, and those bins' pieces (a small part, see ``LOOSE_FILL``) are packed again by fewer
shards until one round gains nothing.  Equal lengths are interchangeable, so a shard needs
only a count of pieces per length.

Null texts count as empty: their sequence is the end id alone.  Repeated ids give a row set
each.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import gc
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, spill, text_or_empty
from .textkit import Numbers, parts, ranges

CAPACITY, END_ID = 4096, 1
SHARD_PIECES = 40_000
LOOSE_FILL = 0.98
#: Words whose ids a task keeps, at about 200 bytes each, and parts of words.
CACHE_WORDS, CACHE_PIECES = 300_000, 50_000
#: Text bytes whose words are looked up together.
TOGETHER_BYTES = 1 << 18
TOKENIZER = "word_bpe_49k.json"


def _byte_letters() -> dict[int, str]:
    """The character that a byte-level vocabulary writes for each byte: printable ones stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = (b for b in range(256) if b not in set(plain))
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = "".join(chr(c) for c in range(0x250) if chr(c).isalpha() and chr(c).lower() == chr(c))
#: The vocabulary's pre-tokeniser for lower-case words of the Latin blocks, a line break after each.
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9\n]+|\n")
#: Letters whose lower case lies beyond those blocks, so that the pre-tokeniser above wouldn't know it.
_BEYOND = "".join(chr(c) for c in range(0x250) if any(ord(x) >= 0x250 for x in chr(c).lower()))
#: Words with any of these go to the tokeniser itself.
_ODD = re.compile(rf"[^\n\x21-\u024F]|[\x7F-\xA0\u00B2\u00B3\u00B9\u00BC-\u00BE\u0130{_BEYOND}]|<\|")


class WordIds(Numbers):
    """Token ids by white-space word: word -> its number; ``encode_all`` gives texts' ids.

    The vocabulary's pre-tokeniser never spans white space, so a text's ids are its words'
    ids in order.  The distinct words that some texts bring along are cut into pieces together, and each distinct piece is encoded once.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.fresh = []
        self.flat, self.start, self.length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)
        self._reset_pieces()

    def _reset_pieces(self) -> None:
        self.pieces = Numbers()
        self.piece_flat, self.piece_start, self.piece_length = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _merged(self, piece: str) -> list[int]:
        if piece == "\n":
            return []
        return [t.id for t in self.merge(piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode())))]

    def _cut(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of simple words, one after the other, and how many each has."""
        if len(self.pieces) > CACHE_PIECES:
            self._reset_pieces()
        found = _PIECE.findall("\n".join([*words, ""]).lower())
        at = np.fromiter(map(self.pieces.__getitem__, found), np.int64, len(found))
        new = list(map(self._merged, self.pieces.taken()))
        length = np.fromiter(map(len, new), np.int64, len(new))
        flat, start = np.fromiter(chain.from_iterable(new), np.uint32, int(length.sum())), np.cumsum(length) - length + len(self.piece_flat)
        self.piece_flat, self.piece_start, self.piece_length = np.append(self.piece_flat, flat), np.append(self.piece_start, start), np.append(self.piece_length, length)
        size = self.piece_length[at]
        ends = np.cumsum(size)[at == self.pieces["\n"]]
        return self.piece_flat[ranges(self.piece_start[at], size)], np.diff(ends, prepend=0)

    def _learn(self, words: list[bytes]) -> None:
        text = b"\n".join(words).decode()
        lines = text.split("\n")
        odd = [i for i, w in enumerate(lines) if _ODD.search(w)] if _ODD.search(text) else []
        whole = [self.tokenizer.encode(lines[i], add_special_tokens=False).ids for i in odd]
        flat, size = np.array(list(chain.from_iterable(whole)), np.uint32), np.array([len(x) for x in whole], np.int64)
        starts, lengths = np.empty(len(lines), np.int64), np.empty(len(lines), np.int64)
        starts[odd], lengths[odd] = np.cumsum(size) - size + len(self.flat), size
        if len(odd) < len(lines):
            simple = np.ones(len(lines), bool)
            simple[odd] = False
            ids, size = self._cut([lines[i] for i in np.flatnonzero(simple).tolist()] if odd else lines)
            starts[simple], lengths[simple] = np.cumsum(size) - size + len(self.flat) + len(flat), size
            flat = np.append(flat, ids)
        self.flat, self.start, self.length = np.append(self.flat, flat), np.append(self.start, starts), np.append(self.length, lengths)

    def encode_all(self, texts: list[bytes]) -> list[np.ndarray]:
        if len(self) > CACHE_WORDS:
            self.reset()
        split = [t.split() for t in texts]  # on [\x20\x09-\x0D]
        words = list(chain.from_iterable(split))
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.fresh:
            self._learn(self.taken())
        size = self.length[at]
        ids, ends = self.flat[ranges(self.start[at], size)], np.append(0, np.cumsum(size))
        return np.split(ids, ends[np.cumsum([len(x) for x in split])][:-1])

    def encode(self, text: bytes) -> np.ndarray:
        return self.encode_all([text])[0]


_word_ids: dict[str, WordIds] = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _worker_ids(path: str | None) -> WordIds:
    path = path or tokenizer_path()
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]


PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def tokenised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and the ids)."""
    fields = [*PIECES, *([pa.field("ids", pa.list_(pa.int32()))] if with_ids else [])]
    out_schema = pa.schema(fields)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _worker_ids(path)
        gc.disable()  # the cache has many small objects and no cycles
        try:
            for batch in batches:
                rows: list[tuple] = []
                all_docs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in parts(texts, TOGETHER_BYTES):
                    for doc, found in zip(all_docs[a:b], known.encode_all(texts[a:b]), strict=True):
                        ids = np.append(found, np.uint32(END_ID)).astype("<u4")
                        for k, at in enumerate(range(0, len(ids), capacity)):
                            part = ids[at : at + capacity]
                            rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
                columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=out_schema)
        finally:  # the worker goes on to other tasks
            known.reset()
            gc.enable()

    kinds = {"doc_id": "long", "piece": "int", "start": "long", "length": "long", "ids_crc32": "long", "ids": "array<int>"}
    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    return source.mapInArrow(encode, ", ".join(f"{f.name} {kinds[f.name]}" for f in fields))


def best_two_fit(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of every piece."""
    lengths = np.asarray(lengths, np.int64)
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1]
    next_of = np.cumsum(count) - count  # the next unused piece of a length, in ``order``
    # longest[g]: the longest length of at most g that is still there, by path compression
    longest = np.arange(capacity + 1)

    def find(g: int) -> int:
        root = g
        while root and not count[root]:
            root = longest[root] if longest[root] < root else root - 1
        while g > root:
            longest[g], g = root, longest[g] if longest[g] < g else g - 1
        return root

    number, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    left, bins, sizes = len(lengths), 0, np.flatnonzero(count)
    while left:
        held, gap = [], capacity
        while (size := find(gap)):
            held.append(size)
            count[size] -= 1
            gap -= size
        if gap and len(held) > 1:
            small, room = held[-1], gap + held[-1]
            if len(sizes) and not count[sizes].all():
                sizes = sizes[count[sizes] > 0]
            one = sizes[sizes < room]
            if len(one):
                # for every first piece the longest second one that fits; a pair of one length needs two pieces
                at = np.searchsorted(sizes, room - one, side="right") - 1
                twice = (at >= 0) & (sizes[at] == one) & (count[one] < 2)
                at = at - twice
                pair = np.where(at >= 0, one + sizes[at], 0)
                best = int(pair.argmax())
                if pair[best] > small:
                    count[small] += 1
                    longest[small] = small
                    held[-1:] = [int(one[best]), int(sizes[at[best]])]
                    count[held[-1]] -= 1
                    count[held[-2]] -= 1
                    if small not in sizes:
                        sizes = np.sort(np.append(sizes, small))
                    # lengths between small and its old root find it again
                    longest[small:] = np.arange(small, capacity + 1)
        at = 0
        for size in held:
            row = order[next_of[size]]
            next_of[size] += 1
            number[row], offset[row] = bins, at
            at += size
        left -= len(held)
        bins += 1
    return number, offset


def _packed(pieces: DataFrame, shards: int, capacity: int, first: int) -> DataFrame:
    """``pieces`` with sequence_id and offset, packed shard by shard."""
    kept = [c for c in pieces.columns if c not in ("sequence_id", "offset", "filled", "shard")]

    def pack(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "piece", "start"], kind="stable").reset_index(drop=True)
        number, offset = best_two_fit(rows["length"].to_numpy(), capacity)
        filled = np.bincount(number, weights=rows["length"].to_numpy()).astype(np.int64)
        out = rows[kept].copy()
        out["sequence_id"] = ((first + key[0]) << 32) + number
        out["offset"], out["filled"] = offset, filled[number]
        return out

    types = dict(pieces.dtypes)
    shard = F.pmod(F.xxhash64("doc_id", "piece", F.lit(first)), F.lit(shards)).alias("shard")
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", sequence_id long, offset long, filled long"
    return pieces.select(*kept, shard).groupBy("shard").applyInPandas(pack, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, path: str | None = None, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = spill(tokenised(docs, id_col, text_col, capacity, path), "pieces")
    left, first, done, before = pieces, 0, [], None
    while True:
        n = left.count()
        shards = max(1, -(-n // shard_pieces))
        packed = spill(_packed(left, shards, capacity, first), "packed")
        if shards == 1 or before is not None and n > 0.9 * before:
            done.append(packed)
            break
        # what other shards' pieces may still fill is packed again
        full = F.col("filled") >= F.lit(int(capacity * LOOSE_FILL))
        done.append(packed.where(full))
        left, first, before = packed.where(~full), first + shards, n
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("filled")
