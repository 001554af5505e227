"""Numpy kernels over chunks of documents, and the exchange between chunks and key buckets.

Several operators ask one question: which keys (word windows, byte strings, words) occur
elsewhere, or how often?  Their documents are dealt over *chunks* by a hash of their id.  A
chunk sends its keys, packed, to *buckets* by hash value; a bucket sees every chunk's copy of
a key, and answers each chunk by the keys' ordinal numbers in it.  So Spark shuffles a
few packed rows for each pair of chunk and bucket instead of a row for each key, and a frequent key reaches its bucket at most a few times from each chunk.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pieces_for, text_or_empty

_rng = np.random.default_rng(20240229)
#: Random odd values for bytes, and a multiplier for places: fixed by the seed.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACE = np.uint64(0x9E3779B97F4A7C15)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUE[IS_SPACE] = 0
CHUNK_BYTES = 14 << 20
NULL_ID = -(2**63)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Numbers(dict):
    """Consecutive numbers for new keys; ``taken`` gives the keys that are new since it was called last."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str | bytes] = []

    def __missing__(self, key: str | bytes) -> int:
        self[key] = n = len(self)
        self.fresh.append(key)
        return n

    def taken(self) -> list[str | bytes]:
        out, self.fresh = self.fresh, []
        return out


def parts(texts: list, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` characters or bytes."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= most:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as one array, a space after each, and where each starts (one more at the end)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) + 1 for t in texts], out=starts[1:])
    return np.frombuffer(b" ".join([*texts, b""]), np.uint8), starts


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's number of words."""
    data, starts = joined(texts)
    if not len(data):
        return np.empty(0, np.uint64), np.zeros(len(texts), np.int64)
    space = IS_SPACE[data]
    first = ~space
    first[1:] &= space[:-1]
    at = np.flatnonzero(first)
    n_words = np.searchsorted(at, starts[1:]) - np.searchsorted(at, starts[:-1])
    if not len(at):
        return np.empty(0, np.uint64), n_words
    del space, first
    # sum of byte value times PLACE ** (place in the word); spaces count nothing
    data = data[at[0] :]
    at0 = at - at[0]
    size = np.diff(np.append(at0, len(data)))
    power = np.cumprod(np.full(int(size.max()), PLACE, np.uint64))
    terms = power[np.arange(len(data)) - np.repeat(at0, size)]
    terms *= BYTE_VALUE[data]
    return mix(np.add.reduceat(terms, at0)), n_words


def runs_hash(values: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hashes of every run of ``width`` values (across texts too)."""
    n = len(values) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = values[:n].copy()
    for j in range(1, width):
        out *= PLACE
        out += values[j : j + n]
    return mix(out)


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0]+1, ... for every range, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """An integer array, as differences if it rises, by byte planes, compressed."""
    values = np.ascontiguousarray(values)
    if rising and len(values):
        values = np.concatenate([values[:1], np.diff(values)])
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.dtype.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, dtype: type, rising: bool = False) -> np.ndarray:
    item = np.dtype(dtype).itemsize
    planes = np.frombuffer(pa.decompress(data, n * item, codec="zstd", asbytes=True), np.uint8)
    values = np.ascontiguousarray(planes.reshape(item, n).T).view(dtype).ravel()
    return np.cumsum(values, dtype=dtype) if rising else values


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int, bytes_each: int = CHUNK_BYTES) -> DataFrame:
    """chunk, doc_id, text (as bytes), dealt over chunks of about ``bytes_each`` of text; ``size``: bytes of all texts."""
    n = pieces_for(size, bytes_each, least=64)
    # rows without an id are dealt by their text
    chunk: Column = F.pmod(F.xxhash64(F.col(id_col), F.when(F.col(id_col).isNull(), F.col(text_col))), F.lit(n)).cast("int")
    return docs.select(chunk.alias("chunk"), F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))


def in_order(table: pa.Table) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Ids, texts and null flags of a chunk's rows by id, then text: the same order in every run."""
    ids = table.column("doc_id").fill_null(NULL_ID).to_numpy()
    texts = table.column("text").to_pylist()
    order = np.argsort(ids, kind="stable")
    if len(ids) > 1 and (ids[order][1:] == ids[order][:-1]).any():
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], texts[i])))
    nulls = table.column("doc_id").is_null().to_numpy()
    return ids[order], [texts[i] for i in order], nulls[order]
