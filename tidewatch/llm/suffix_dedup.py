"""Removal of repeated byte strings with suffix arrays.

Every string of ``length`` bytes that starts in two or more places is removed from all of them.

*Dealing.*  A string's key is the smallest hash among its 32-byte substrings, so equal strings
have equal keys wherever they are.  Neighbouring strings mostly share their key: a *stretch*
is a range of starts with one key, at most ``STRETCH`` of them, and its bytes hold all its strings.  Chunks send each
different stretch (key and content hash) to the key's bucket, which sees all its stretches:

-   only one, whose key comes from one place in it: its strings occur once;
-   the same content twice or more: all its strings repeat;
-   different contents, or one that may repeat its own strings: one copy of each is sent, as bytes, to a shard.

*Sorting.*  A shard is the bytes of all its stretches, a separator after each.  It builds the
suffix array by induced sorting, and the permuted common prefixes; a string repeats if it
shares ``length`` bytes with the suffix before or after it in the order.  So equal contents are compared once.
Only stretches of one key can share a string, so a shard is sorted in batches of whole keys of about ``BATCH_BYTES``.

*Common keys.*  A short passage of many documents is the key of as many different stretches as it has neighbourhoods,
and their number grows with the input.  Stretches of a key with more than ``FEW`` different ones (or ``KEY_BYTES``) are
cut anew by keys of longer substrings (128 bytes for strings of 200), which few of them share, and go through buckets a
second time: most turn out to occur once and are not sent.  What is still common then (long passages with many
neighbourhoods) is sent as single strings, each to the shard that the string's own hash names, once from a chunk.

Null texts count as empty.  Matches never cross documents.  Rows that repeat an id count as
different documents.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, pieces_for, text_bytes
from .suffix_array import permuted_common_prefixes, suffix_array
from .textkit import BYTE_VALUE, PLACE, chunked, in_order, joined, mix, packed, parts, ranges, unpacked

LENGTH, GRAM, STRETCH = 200, 32, 1024
#: Bytes whose substrings are hashed, and whose removed runs are marked, at once: both take many times as much memory.
PART_BYTES = 1 << 19
#: Text bytes for each bucket of keys and each shard; bytes sorted at once; bytes of one key that one shard takes.
BUCKET_BYTES, SHARD_BYTES, BATCH_BYTES, KEY_BYTES = 27 << 20, 7 << 19, 3 << 19, 1 << 20
#: Different stretches of one key that one shard takes.
FEW = 2000
ANSWER = "chunk int, state int, n int, starts binary, sizes binary, keys binary"
#: Rows with a state are answers that a bucket passes on.
SENT = f"bucket int, {ANSWER}, contents binary, marks binary"
SHIPPED = "shard int, chunk int, wanted boolean, key long, start long, size int, data binary"
KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_text binary, kept_sha256 string"
REPEATED, SHIP, SHIP_AND_REPEATED, DIVIDE, DIVIDE_AND_REPEATED = range(5)

_PLACE_BITS = np.uint64((1 << 24) - 1)
_BYTES = np.where(BYTE_VALUE == 0, np.arange(256, dtype=np.uint64) * PLACE + np.uint64(7), BYTE_VALUE)


def _gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of the substrings of ``gram`` bytes, a power of two, by doubling."""
    h, step, power = _BYTES[data], 1, PLACE
    with np.errstate(over="ignore"):
        while step < gram:
            h = h[: len(h) - step] * power + h[step:]
            power, step = power * power, step * 2
    return mix(h)


def _least_in_windows(h: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    step, low = 1, h
    while step * 2 <= width:
        low = np.minimum(low[: len(low) - step], low[step:])
        step *= 2
    return np.minimum(low[: len(h) - width + 1], low[width - step : width - step + len(h) - width + 1])


def _keys(gram: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The key of each window of ``width`` grams, and the place where it comes from.

    The leftmost of the grams with the smallest leading bits is taken: equal windows agree on it.
    """
    place = np.arange(len(gram), dtype=np.uint64)
    least = _least_in_windows((gram & ~_PLACE_BITS) | place, width) & _PLACE_BITS
    return gram[least.astype(np.int64)], least


def _cut(data: np.ndarray, first_start: np.ndarray, count: np.ndarray, length: int, limit: int, size: int = GRAM):
    """Stretches of texts that lie in ``data``: key, content hash, start, number of starts, loops.

    ``size``: bytes of the substrings that are keys.

    ``loops``: whether the key comes from two places, without which no two strings of the
    stretch can be equal.
    """
    if not count.sum():
        return np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    with np.errstate(over="ignore"):
        gram = _gram_hashes(data, size)
        key, place = _keys(gram, length - size + 1)
        at = ranges(first_start, count)
        key, place = key[at], place[at]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(at)))
        moved = np.zeros(len(at), bool)
        moved[1:] = (place[1:] != place[:-1]) & ~new[1:]
        loops = np.add.reduceat(moved, first, dtype=np.int64) > 0
        key, pieces = key[first], -(-n // limit)
        step = ranges(np.zeros(len(first), np.int64), pieces) * limit
        start, n = np.repeat(at[first], pieces) + step, np.minimum(np.repeat(n, pieces) - step, limit)
        # contents: the sum of the grams, each weighed by its place in the stretch
        power = np.cumprod(np.full(len(gram), PLACE, np.uint64))
        back = np.cumprod(np.full(len(gram), np.uint64(pow(int(PLACE), -1, 2**64)), np.uint64))
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(gram * power)])
        content = (running[start + n + length - size] - running[start]) * back[start]
        return np.repeat(key, pieces), mix(content + n.astype(np.uint64)), start, n, np.repeat(loops, pieces)


def stretches(texts: list[bytes], length: int = LENGTH, limit: int = STRETCH) -> list[np.ndarray]:
    """Of all texts, with starts counted from the first byte (and a space after each text).

    Short texts go together; a long text goes in parts that overlap by ``length - 1`` bytes.
    """
    base = np.cumsum([0, *(len(t) + 1 for t in texts)])
    out = [_cut(np.empty(0, np.uint8), base[:0], base[:0], length, limit)]
    first = 0
    while first < len(texts):
        last = first + 1
        while last < len(texts) and base[last + 1] - base[first] <= PART_BYTES:
            last += 1
        if last > first + 1 or len(texts[first]) <= PART_BYTES:
            data, own = joined(texts[first:last])
            found = _cut(data, own[:-1], np.maximum(np.diff(own) - length, 0), length, limit)
            out.append((*found[:2], found[2] + base[first], *found[3:]))
        else:
            data = np.frombuffer(texts[first], np.uint8)
            for low in range(0, len(data) - length + 1, PART_BYTES):
                part = data[low : low + PART_BYTES + length - 1]
                found = _cut(part, np.array([0]), np.array([len(part) - length + 1]), length, limit)
                out.append((*found[:2], found[2] + base[first] + low, *found[3:]))
        first = last
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _cut_again(data: np.ndarray, start: np.ndarray, size: np.ndarray, length: int, limit: int, gram: int) -> list[np.ndarray]:
    """Stretches, as of :func:`_cut`, of the strings of given stretches, and the number of the one that each comes from."""
    nothing = np.empty(0, np.int64)
    out = [(*_cut(np.empty(0, np.uint8), nothing, nothing, length, limit, gram), nothing)]
    long = size + length - 1
    part = np.cumsum(long) // PART_BYTES
    edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else nothing
    for low, high in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        own = np.cumsum(long[low:high]) - long[low:high]
        found = _cut(data[ranges(start[low:high], long[low:high])], own, size[low:high], length, limit, gram)
        of = np.searchsorted(own, found[2], "right") - 1
        out.append((*found[:2], found[2] + (start[low:high] - own)[of], *found[3:], of + low))
    return [np.concatenate(x) for x in zip(*out, strict=True)]


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def _answer(chunk: int, state: int, starts: np.ndarray, sizes: np.ndarray, keys: np.ndarray | None = None) -> dict:
    order = np.argsort(starts, kind="stable")
    out = {"chunk": chunk, "state": state, "n": len(starts), "starts": packed(starts[order].astype(np.int64), True), "sizes": packed(sizes[order].astype(np.int32))}
    if keys is not None:
        out["keys"] = packed(keys[order])
    return out


def _stretches_of(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Start and number of starts of all stretches in answers."""
    rows = answers.select(["n", "starts", "sizes"]).to_pylist()
    start = [unpacked(r["starts"], r["n"], np.int64, True) for r in rows]
    size = [unpacked(r["sizes"], r["n"], np.int32).astype(np.int64) for r in rows]
    return (np.concatenate(start), np.concatenate(size)) if rows else (np.empty(0, np.int64), np.empty(0, np.int64))


def _among(table: pa.Table, *states: int) -> pa.Table:
    return table.filter(pc.is_in(table.column("state"), pa.array(states, pa.int32())))


def _dealt(chunk: int, found: list[np.ndarray], buckets: int) -> list[dict]:
    """A chunk's stretches as rows to the buckets of their keys, each different one once."""
    key, content, start, size, loops = found
    order = np.lexsort((start, content, key))
    key, content, start, size, loops = (x[order] for x in (key, content, start, size, loops))
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (content[1:] != content[:-1])
    group = np.cumsum(new) - 1
    twice = np.bincount(group, minlength=int(new.sum())) > 1
    here = twice[group] if len(group) else np.empty(0, bool)
    rows = [{"bucket": chunk % buckets} | _answer(chunk, REPEATED, start[here], size[here])] if here.any() else []
    key, content, start, size, loops = (x[new] for x in (key, content, start, size, loops))
    # keys are least hashes, so small: mixed again for an even deal
    spread = (mix(key) >> np.uint64(33)).astype(np.int64) % buckets
    by = np.argsort(spread, kind="stable")
    cut = np.searchsorted(spread[by], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cut)).tolist():
        part = by[cut[b] : cut[b + 1]]
        rows.append(
            {
                "bucket": b,
                "chunk": chunk,
                "n": len(part),
                "keys": packed(key[part], True),
                "contents": packed(content[part]),
                "starts": packed(start[part]),
                "sizes": packed(size[part].astype(np.int32)),
                "marks": packed(twice[part] + np.uint8(2) * loops[part]),
            }
        )
    return rows


def _send(length: int, buckets: int):
    def send(table: pa.Table) -> pa.Table:
        chunk = table.column("chunk")[0].as_py()
        return pa.Table.from_pylist(_dealt(chunk, stretches(in_order(table)[1], length), buckets), schema=_schema(SENT))

    return send


def _divide(length: int, buckets: int):
    """Stretches of common keys, cut anew by keys of longer substrings; others that are to be sent are passed on."""
    gram = max(GRAM, 1 << (length * 3 // 4).bit_length() - 1)

    def divide(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[dict] = []
        if left.num_rows and right.num_rows:
            chunk = right.column("chunk")[0].as_py()
            rows = [{"bucket": chunk % buckets} | r for r in _among(right, SHIP, SHIP_AND_REPEATED).to_pylist()]
            start, size = _stretches_of(_among(right, DIVIDE, DIVIDE_AND_REPEATED))
            if len(start):
                data, _ = joined(in_order(left)[1])
                rows += _dealt(chunk, _cut_again(data, start, size, length, STRETCH, gram)[:5], buckets)
        return pa.Table.from_pylist(rows, schema=_schema(SENT))

    return divide


def _sift(length: int, few: int):
    def sift(table: pa.Table) -> pa.Table:
        columns = _schema(ANSWER).names
        out = table.filter(pc.is_valid(table.column("state"))).select(columns).to_pylist()
        rows = table.filter(pc.is_null(table.column("state"))).to_pylist()
        if rows:
            key = np.concatenate([unpacked(r["keys"], r["n"], np.uint64, True) for r in rows])
            content = np.concatenate([unpacked(r["contents"], r["n"], np.uint64) for r in rows])
            start = np.concatenate([unpacked(r["starts"], r["n"], np.int64) for r in rows])
            size = np.concatenate([unpacked(r["sizes"], r["n"], np.int32) for r in rows])
            marks = np.concatenate([unpacked(r["marks"], r["n"], np.uint8) for r in rows])
            chunk = np.repeat(np.array([r["chunk"] for r in rows], np.int32), [r["n"] for r in rows])
            del rows
            order = np.lexsort((chunk, content, key))
            key, content, start, size, marks, chunk = (x[order] for x in (key, content, start, size, marks, chunk))
            twice, loops = marks & 1, marks > 1
            new_key = np.ones(len(key), bool)
            new_key[1:] = key[1:] != key[:-1]
            new = new_key.copy()
            new[1:] |= content[1:] != content[:-1]
            of_key, of_content = np.cumsum(new_key) - 1, np.cumsum(new) - 1
            contents = np.bincount(of_key[new])[of_key]
            repeated = (np.bincount(of_content) + np.bincount(of_content, weights=twice) > 1)[of_content]
            ship = new & ((contents > 1) | (loops & ~repeated))
            common = (contents > few) | (np.bincount(of_key[new], weights=size[new] + length - 1)[of_key] > KEY_BYTES)
            state = np.where(ship, np.where(common, DIVIDE, SHIP) + repeated, np.where(repeated, REPEATED, -1))
            # stretches repeated within their chunk have been answered there
            at = np.flatnonzero((state > REPEATED) | ((state == REPEATED) & (twice == 0)))
            at = at[np.lexsort((state[at], chunk[at]))]
            edge = np.flatnonzero((np.diff(chunk[at]) != 0) | (np.diff(state[at]) != 0)) + 1
            for part in np.split(at, edge) if len(at) else []:
                s = int(state[part[0]])
                out.append(_answer(int(chunk[part[0]]), s, start[part], size[part], None if s == REPEATED else key[part]))
        return pa.Table.from_pylist(out, schema=_schema(ANSWER))

    return sift


def _ship(length: int, shards: int):
    """The bytes of the stretches asked for, to their shards."""

    def shipped(chunk: int, key: np.ndarray, start: np.ndarray, size: np.ndarray, wanted: np.ndarray, data: pa.Array) -> pa.Table:
        shard = (mix(key) >> np.uint64(33)).astype(np.int64) % shards
        return pa.Table.from_arrays([shard.astype(np.int32), np.full(len(key), chunk, np.int32), wanted, key.view(np.int64), start, size.astype(np.int32), data], schema=_schema(SHIPPED))

    def ship(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [_schema(SHIPPED).empty_table()]
        if left.num_rows and right.num_rows:
            data, _ = joined(in_order(left)[1])
            chunk = right.column("chunk")[0].as_py()
            for state in (SHIP, SHIP_AND_REPEATED):
                rows = _among(right, state)
                start, size = _stretches_of(rows)
                if len(start):
                    key = np.concatenate([unpacked(r["keys"], r["n"], np.uint64) for r in rows.to_pylist()])
                    whole = pa.array([data[a:b].tobytes() for a, b in zip(start.tolist(), (start + size + length - 1).tolist(), strict=True)], pa.binary())
                    out.append(shipped(chunk, key, start, size, np.full(len(key), state == SHIP), whole))
            known, new = (_stretches_of(_among(right, s)) for s in (DIVIDE_AND_REPEATED, DIVIDE))
            start, size = (np.concatenate(x) for x in zip(known, new, strict=True))
            if len(start):
                # each string of what is still common goes where its hash says, once from a chunk
                _, string, at, one, _, of = _cut_again(data, start, size, length, 1, GRAM)
                string, first, group, times = np.unique(string, return_index=True, return_inverse=True, return_counts=True)
                again = np.sort(at[times[group] > 1])
                bytes_of = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[at[first]])
                whole = pa.FixedSizeBinaryArray.from_buffers(pa.binary(length), len(first), [None, pa.py_buffer(bytes_of)]).cast(pa.binary())
                out.append(shipped(chunk, string, at[first], one[first], (of[first] >= len(known[0])) & (times == 1), whole))
                if len(again):  # these repeat within the chunk: the answer goes through a shard
                    out.append(pa.Table.from_pylist([{"shard": int(again[0]) % shards, "chunk": chunk, "size": len(again), "data": packed(again, True)}], schema=_schema(SHIPPED)))
        return pa.concat_tables(out)

    return ship


def repeated_starts(parts: list[bytes], length: int) -> list[np.ndarray]:
    """For each part, which of its strings of ``length`` bytes occur in another place of any part."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    code = np.zeros(int(ends[-1]), np.int16)
    keep = np.ones(len(code), bool)
    keep[ends - 1] = False
    code[keep] = np.frombuffer(b"".join(parts), np.uint8)
    code[keep] += 1
    order = suffix_array(code)
    # as bytes: a separator can't be told from one byte value, but no string reaches a separator
    data = np.zeros(len(code), np.uint8)
    data[keep] = np.frombuffer(b"".join(parts), np.uint8)
    before, prefix = permuted_common_prefixes(data, order, code)
    inside = np.zeros(len(code), bool)
    inside[ranges(ends - 1 - sizes, np.maximum(sizes - length + 1, 0))] = True
    hit = np.flatnonzero((prefix >= length) & inside & (before >= 0))
    hit = hit[inside[before[hit]]]
    flag = np.zeros(len(code), bool)
    flag[hit] = flag[before[hit]] = True
    return [flag[e - 1 - n : e - 1 - n + max(n - length + 1, 0)] for e, n in zip(ends, sizes, strict=True)]


def _resolve(length: int):
    def resolve(table: pa.Table) -> pa.Table:
        known = table.filter(pc.is_null(table.column("wanted"))).to_pylist()
        rows = [_answer(r["chunk"], REPEATED, unpacked(r["data"], r["size"], np.int64, True), np.ones(r["size"], np.int64)) for r in known]
        table = table.filter(pc.is_valid(table.column("wanted"))).sort_by([("key", "ascending"), ("chunk", "ascending"), ("start", "ascending")])
        key = table.column("key").to_numpy()
        # equal strings have equal keys: whole keys are sorted together, a batch of them at once
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
        before = np.concatenate([[0], np.cumsum(pc.binary_length(table.column("data")).to_numpy(), dtype=np.int64)])[first]
        edge = [*first[np.flatnonzero(np.diff(before // BATCH_BYTES, prepend=-1))].tolist(), len(key)]
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for low, high in zip(edge[:-1], edge[1:], strict=True):
            part = table.slice(low, high - low)
            flags = repeated_starts(part.column("data").to_pylist(), length)
            for chunk, wanted, start, flag in zip(*(part.column(c).to_pylist() for c in ("chunk", "wanted", "start")), flags, strict=True):
                if wanted and flag.any():
                    step = np.flatnonzero(np.diff(np.concatenate([[0], flag.view(np.int8), [0]])))
                    found.setdefault(chunk, []).append((step[::2] + start, step[1::2] - step[::2]))
        rows += [_answer(c, REPEATED, *(np.concatenate(x) for x in zip(*x, strict=True))) for c, x in found.items()]
        return pa.Table.from_pylist(rows, schema=_schema(ANSWER))

    return resolve


def _finish(length: int, with_text: bool):
    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=_schema(KEPT))
        ids, texts, nulls = in_order(left)
        start, size = _stretches_of(right)
        order = np.argsort(start, kind="stable")
        start, size = start[order], size[order]
        base = np.cumsum([0, *(len(t) + 1 for t in texts)])
        rows = []
        # no string reaches beyond its document
        for low, high in parts(texts, PART_BYTES):
            data, _ = joined(texts[low:high])
            a, b = np.searchsorted(start, base[[low, high]])
            step = np.zeros(len(data) + 1, np.int32)
            np.add.at(step, start[a:b] - base[low], 1)
            np.add.at(step, start[a:b] - base[low] + size[a:b] + length - 1, -1)
            gone = np.cumsum(step[:-1], dtype=np.int32) > 0
            for i in range(low, high):
                text, spans = texts[i], 0
                cut = gone[base[i] - base[low] :][: len(text)]
                removed = int(cut.sum())
                if removed:
                    spans = int(cut[0]) + int((cut[1:] & ~cut[:-1]).sum())
                    text = np.frombuffer(text, np.uint8)[~cut].tobytes()
                rows.append((None if nulls[i] else int(ids[i]), len(cut), removed, spans, text if with_text else None, hashlib.sha256(text).hexdigest()))
        return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _schema(KEPT), strict=True)], schema=_schema(KEPT))

    return finish


def remove_repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True, few: int = FEW) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_text (bytes, on request) and kept_sha256 of every row."""
    text_size = text_bytes(docs, text_col)
    rows = chunked(in_small_batches(docs), id_col, text_col, text_size)
    buckets = pieces_for(text_size, BUCKET_BYTES, least=64)
    shards = pieces_for(text_size, SHARD_BYTES, least=64)
    state = F.col("state")
    sent = rows.groupBy("chunk").applyInArrow(_send(length, buckets), SENT)
    answers = sent.groupBy("bucket").applyInArrow(_sift(length, few), ANSWER)
    wanted = answers.where(state != REPEATED)
    divided = rows.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(_divide(length, buckets), SENT)
    final = divided.groupBy("bucket").applyInArrow(_sift(length, few), ANSWER)
    shipped = rows.groupBy("chunk").cogroup(final.where(state != REPEATED).groupBy("chunk")).applyInArrow(_ship(length, shards), SHIPPED)
    found = shipped.groupBy("shard").applyInArrow(_resolve(length), ANSWER)
    # what is to be sent has been passed on from the first answers to the final ones
    every = answers.where(state.isin(REPEATED, DIVIDE_AND_REPEATED)).unionByName(final.where(~state.isin(SHIP, DIVIDE))).unionByName(found)
    return rows.groupBy("chunk").cogroup(every.groupBy("chunk")).applyInArrow(_finish(length, with_text), KEPT)


def suffix_digest(docs: DataFrame) -> DataFrame:
    return remove_repeated_bytes(docs, with_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
