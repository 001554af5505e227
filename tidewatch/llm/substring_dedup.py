"""Substring deduplication with Rabin-Karp hashes of fixed-length word windows.

Words are ``[^\\x20\\x09-\\x0D]+``.  Every window of ``width`` consecutive words of one document gets a
64-bit hash; Spark brings equal hashes together and finds the smallest document id that has
each.  A window is repeated if it also starts in a document with a smaller id, and repeated
windows that touch or overlap merge into maximal intervals, which are removed.

Chunks send a window once, for the smallest of their documents that has it (other documents of
the chunk are decided in the chunk), so no passage is too frequent for one bucket.

Null texts count as empty.  Texts of fewer than ``width`` words keep all their words.  Rows that
repeat an id don't make each other's windows repeated.  Null ids count as smaller than all others.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_for, text_bytes
from .textkit import chunked, in_order, packed, ranges, runs_hash, unpacked, word_hashes

WIDTH = 13
#: Text bytes for each bucket of windows.
BUCKET_BYTES = 7 << 20
SENT = "bucket int, chunk int, n int, hashes binary, ordinals binary, docs binary, n_docs int, starts binary"
ANSWER = "chunk int, n int, ordinals binary"
KEPT = "doc_id long, n_words long, n_removed long, n_spans long, kept_text binary, kept_sha256 string"


def _window_starts(n_words: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and number of windows of every text."""
    return np.cumsum(n_words) - n_words, np.maximum(n_words - width + 1, 0)


def _answers(chunk: int, ordinals: np.ndarray) -> dict:
    return {"chunk": chunk, "n": len(ordinals), "ordinals": packed(np.sort(ordinals).astype(np.uint32), True)}


def _send(width: int, buckets: int):
    """A chunk's windows for the buckets; those decided in the chunk pass through one of them."""

    def send(table: pa.Table) -> pa.Table:
        ids, texts, _ = in_order(table)
        chunk = table.column("chunk")[0].as_py()
        hashes, n_words = word_hashes(texts)
        first, count = _window_starts(n_words, width)
        window = runs_hash(hashes, width)[ranges(first, count)] if count.sum() else np.empty(0, np.uint64)
        window_ends = np.cumsum(count)
        owner = np.repeat(ids, count)
        order = np.argsort(window, kind="stable")  # by hash, then id: ids rise with ordinals
        h, d = window[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        least = d[new][np.cumsum(new) - 1] if len(h) else d
        rows = [{"bucket": chunk % buckets, **_answers(chunk, order[d > least])}]
        order = order[d == least]
        h = window[order]
        cut = np.searchsorted((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        for b in np.flatnonzero(np.diff(cut)).tolist():
            part = order[cut[b] : cut[b + 1]]
            # the documents that these windows start in, and each one's first ordinal
            used = np.unique(np.searchsorted(window_ends, part, side="right"))
            rows.append(
                {
                    "bucket": b,
                    "chunk": chunk,
                    "n": len(part),
                    "hashes": packed(h[cut[b] : cut[b + 1]], True),
                    "ordinals": packed(part.astype(np.uint32)),
                    "docs": packed(ids[used], True),
                    "n_docs": len(used),
                    "starts": packed((window_ends - count)[used].astype(np.uint32), True),
                }
            )
        return pa.Table.from_pylist(rows, schema=_schema(SENT))

    return send


def _decide(table: pa.Table) -> pa.Table:
    """A bucket: which windows also start in a document with a smaller id."""
    sent = table.to_pylist()
    rows = [r for r in sent if r["hashes"] is not None]
    out = [{c: r[c] for c in ("chunk", "n", "ordinals")} for r in sent if r["hashes"] is None and r["n"]]
    if not rows:
        return pa.Table.from_pylist(out, schema=_schema(ANSWER))
    hashes = np.concatenate([unpacked(r["hashes"], r["n"], np.uint64, True) for r in rows])
    sizes = np.array([r["n"] for r in rows])
    ordinals = [unpacked(r["ordinals"], r["n"], np.uint32) for r in rows]
    docs = []
    for r, o in zip(rows, ordinals, strict=True):
        ids, starts = unpacked(r["docs"], r["n_docs"], np.int64, True), unpacked(r["starts"], r["n_docs"], np.uint32, True)
        docs.append(ids[np.searchsorted(starts, o, side="right") - 1])
    doc = np.concatenate(docs)
    order = np.argsort(hashes, kind="stable")
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    least = np.minimum.reduceat(doc[order], np.flatnonzero(new))[np.cumsum(new) - 1]
    repeated = np.empty(len(h), bool)
    repeated[order] = doc[order] > least
    ends = np.cumsum(sizes)
    out += [_answers(r["chunk"], o[repeated[e - r["n"] : e]]) for r, o, e in zip(rows, ordinals, ends, strict=True) if repeated[e - r["n"] : e].any()]
    return pa.Table.from_pylist(out, schema=_schema(ANSWER))


def covered(flags: np.ndarray, width: int, first: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a flagged window of ``width`` places."""
    at = (ranges(first, count))[flags]
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, np.minimum(at + width, n), -1)
    return np.cumsum(step[:n]) > 0


def _finish(width: int, with_text: bool):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=_schema(KEPT))
        ids, texts, nulls = in_order(left)
        words = [t.split() for t in texts]  # on [\x20\x09-\x0D]
        n_words = np.array([len(w) for w in words])
        first, count = _window_starts(n_words, width)
        flags = np.zeros(int(count.sum()), bool)
        for r in right.to_pylist():
            flags[unpacked(r["ordinals"], r["n"], np.uint32, True)] = True
        gone = covered(flags, width, first, count, int(n_words.sum()))
        rows = []
        for i, mine in enumerate(words):
            cut = gone[first[i] : first[i] + n_words[i]]
            removed = int(cut.sum())
            kept = b" ".join(compress(mine, ~cut) if removed else mine)
            spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum()) if removed else 0
            rows.append((None if nulls[i] else int(ids[i]), len(mine), removed, spans, kept if with_text else None, hashlib.sha256(kept).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(KEPT), strict=True)], schema=_schema(KEPT))

    return finish


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def remove_repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, n_spans, kept_text (bytes, on request) and kept_sha256 of every row."""
    size = text_bytes(docs, text_col)
    rows = chunked(docs, id_col, text_col, size)
    buckets = pieces_for(size, BUCKET_BYTES, least=64)
    sent = rows.groupBy("chunk").applyInArrow(_send(width, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_decide, ANSWER)
    return rows.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_finish(width, with_text), KEPT)


def substring_digest(docs: DataFrame) -> DataFrame:
    return remove_repeated_windows(docs, with_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256", F.col("n_spans"))
