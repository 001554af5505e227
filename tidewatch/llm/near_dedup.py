"""Near-duplicate detection with Order MinHash.

A document's items are its runs of three words, each labelled with its occurrence number; short
texts have runs of two words or single words (``LEVELS``), and texts between two levels have the sketches of both.  A
sketch takes the ``PICKS`` items with the smallest seeded hashes and keeps them in text order, so
documents share it with a probability that falls with their edit distance.  Documents that share
one of ``SKETCHES`` sketches are candidates.  Candidates are verified by a banded alignment of
their words: similarity = 1 - edit distance / words of the longer text, at least 0.8.

Classes are the connected components of verified links.  Texts with the same words are one
entry throughout, so copies make no pairs.  In a sketch's bucket members are first compared with one
of them.  Then all pairs of members in different classes are looked at, in blocks of at most
``BLOCK`` members and only within lengths that allow the similarity: a pair goes on if its counts of words by hash
allow it too, from the first bucket that its members share.  One pair for each two classes is aligned, and, as that joins many
classes, afterwards every pair whose members are still in different classes.  Before it is aligned, a pair's words and its runs of two words
are counted: an edit changes one word and two runs on either side.  None of these filters ever drops a similar pair.

The least likely pairs, of similarity 0.8 with all edits substitutions at random places, share an
item with a probability of s = 0.8^3, so their sets have J = s / (2 - s) = 0.34 in common and a sketch
is shared with a probability of about J^2 = 0.12: ``SKETCHES`` sketches miss about 1 pair in 8,000 by this estimate (substitutions spread evenly break more items: the tests allow 3 % there).

Null texts count as empty.  Texts without words form one class.  Below five words 0.8 allows no edit.  Every row is judged by its
own text: rows that repeat an id or have none are documents of their own.  A class's id is its smallest one (null if it has none),
and the row that stays is the one with this id, among several of that id the one whose text has the smallest hash; rows equal in id and text can't be told apart
and stay together.  Very long texts take time in proportion to words times edits.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches, spill, text_or_empty, without
from .components import connected
from .textkit import mix, ranges, runs_hash, word_hashes

SHINGLE, PICKS, SKETCHES, SIMILARITY = 3, 2, 72, 0.8
#: (words of an item, least and most words of a text).  Ranges overlap so that two texts of similarity 0.8 have a level in common.
LEVELS = ((1, 0, 12), (2, 10, 48), (SHINGLE, 38, 1 << 62))
#: Bits of a sketch that hold its number.
SLOT_BITS = 8
#: Bins of a text's counts of words by hash; members of a bucket compared at once; pairs held at once.
BINS, BLOCK, PAIRS = 1024, 4096, 1 << 20
#: The bins are added up to so many for a first look.
COARSE = 64
#: Rows that a group of buckets has, about.
SHARD_ROWS = 20_000
PART_CHARS = 4 << 20
#: Edits that the narrowest band allows, and how much wider the next one is; cells of a row of bands, and words, held at once.
NARROW, WIDER, CELLS, HELD_WORDS = 4, 4, 1 << 15, 1 << 20
#: Words above which a text is aligned diagonal by diagonal.
LONG = 1500


def order_min_hash(texts: list[bytes], sketches: int = SKETCHES, picks: int = PICKS, width: int = SHINGLE) -> np.ndarray:
    """(texts, sketches) uint64."""
    words, n_words = word_hashes(texts)
    first = np.cumsum(n_words) - n_words
    count = np.maximum(n_words - width + 1, 0)
    out = np.zeros((len(texts), sketches), np.uint64)
    seeds = mix(np.arange(1, 2 * sketches + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    short = np.flatnonzero(count < picks)
    for i in short:  # too short to choose from: all its words in order
        mine = words[first[i] : first[i] + n_words[i]]
        value = runs_hash(mine, len(mine))[0] if len(mine) else np.uint64(0)
        out[i] = mix(np.full(sketches, value, np.uint64) ^ seeds[:sketches] ^ np.uint64(len(mine)))
    long = np.flatnonzero(count >= picks)
    if not len(long):
        return out
    size = count[long]
    items = runs_hash(words, width)[ranges(first[long], size)]
    starts = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(long)), size)
    # occurrence numbers: the nth copy of an item in its text is an item of its own
    keyed = items + owner.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(keyed, kind="stable")
    same = np.zeros(len(order), bool)
    same[1:] = keyed[order][1:] == keyed[order][:-1]
    if same.any():
        at = np.arange(len(order))
        nth = at - np.maximum.accumulate(np.where(same, 0, at))
        items[order] += nth.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    del keyed, order, same
    items = mix(items)
    largest = np.uint64(2**64 - 1)
    # a value's low bits are its place in the text, so the least value tells where it is
    low = np.uint64((1 << int(size.max()).bit_length()) - 1)
    place = (np.arange(len(items)) - np.repeat(starts, size)).astype(np.uint64)
    value = np.empty_like(items)
    for j in range(sketches):
        np.bitwise_xor(items, seeds[2 * j], out=value)
        value *= seeds[2 * j + 1] | np.uint64(1)
        value &= ~low
        value |= place
        taken = []
        for _ in range(picks):
            hit = starts + (np.minimum.reduceat(value, starts) & low).astype(np.int64)
            taken.append(hit)
            value[hit] = largest
        places = np.sort(np.stack(taken), axis=0)  # text order
        total = np.full(len(long), seeds[2 * j])
        for row in places:
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + items[row])
        out[long, j] = total
    return out


def sketch_keys(texts: list[bytes], sketches: int = SKETCHES) -> tuple[np.ndarray, np.ndarray]:
    """The sketches of all texts at their levels, and how many each text has.

    The lowest ``SLOT_BITS`` bits of a sketch say which one it is.  (No text has sketches of the first and the third level.)
    """
    if len(LEVELS[:2]) * sketches > 1 << SLOT_BITS:
        raise ValueError(f"at most {(1 << SLOT_BITS) // 2} sketches, not {sketches}")
    n = np.array([len(t.split()) for t in texts], np.int64)
    owner, keys = [], []
    for level, (width, least, most) in enumerate(LEVELS):
        mine = np.flatnonzero((n >= least) & (n <= most))
        if len(mine):
            found = order_min_hash([texts[i] for i in mine], sketches, PICKS, width) >> np.uint64(SLOT_BITS) << np.uint64(SLOT_BITS)
            found |= np.arange(sketches, dtype=np.uint64) + np.uint64(level % 2 * sketches)
            keys.append(found.ravel())
            owner.append(np.repeat(mine, sketches))
    if not keys:
        return np.empty(0, np.uint64), n
    at = np.concatenate(owner)
    return np.concatenate(keys)[np.argsort(at, kind="stable")], np.bincount(at, minlength=len(texts))


def _running_least(x: np.ndarray) -> np.ndarray:
    """The least value so far in every column."""
    if x.shape[1] < 16:
        return np.minimum.accumulate(x, axis=0)
    d = 1
    while d < len(x):
        y = np.empty_like(x)
        y[:d] = x[:d]
        np.minimum(x[d:], x[:-d], out=y[d:])
        x, d = y, 2 * d
    return x


def _band(pairs: list[tuple[np.ndarray, np.ndarray]], wide: int, most: np.ndarray) -> np.ndarray:
    """Edits of each pair, right where they are at most ``wide``; pairs that must have more than ``most`` are given up.

    Rows of the table of edits within ``wide`` of its diagonal, for all pairs together: column c of row i is place
    i + c - wide of the second text.  Each value is held less c, so that an insertion costs nothing there, a removal two.
    """
    size = np.array([len(x) for x, _ in pairs])
    order = np.argsort(-size, kind="stable")
    size, goal = size[order], np.array([len(pairs[i][1]) - len(pairs[i][0]) + wide for i in order])
    rows, n = int(size[0]), len(pairs)
    first, second = np.zeros((rows, n), np.uint32), np.full((rows + 2 * wide + 1, n), 2**32 - 1, np.uint32)
    for k, i in enumerate(order.tolist()):
        x, y = pairs[i]
        first[: len(x), k], second[wide : wide + len(y), k] = x, y
    kind = np.int16 if rows + 4 * wide < 1 << 14 else np.int32
    column = np.arange(2 * wide + 1, dtype=kind)[:, None]
    now = np.where(column < wide, np.iinfo(kind).max // 2, -wide).astype(kind).repeat(n, 1)
    out, alive, most = np.full(n, np.iinfo(np.int64).max), np.arange(n), most[order]
    for i in range(rows):
        step = now + (first[i] != second[i : i + 2 * wide + 1])
        np.minimum(step[:-1], now[1:] + kind(2), out=step[:-1])
        now = _running_least(step)
        left = int(np.searchsorted(-size[alive], -(i + 1)))  # pairs with more rows
        ended = np.arange(left, len(alive))
        if len(ended):
            at = goal[alive[ended]]
            out[alive[ended]] = now[at, ended] + at
            keep = np.arange(left)
        elif i % 32 == 31:  # what is missing at least: the way back to the goal's diagonal
            least = (now + column + np.abs(column - goal[alive].astype(kind))).min(0)
            keep = np.flatnonzero(least <= most[alive])
            if len(keep) > 0.75 * len(alive):
                continue
        else:
            continue
        if not len(keep):
            break
        alive, now, first, second = alive[keep], now[:, keep], first[:, keep], second[:, keep]
    found = np.empty(n, np.int64)
    found[order] = out
    return found


def _furthest(x: np.ndarray, y: np.ndarray, limit: int) -> int:
    """Edits between two long texts, or ``limit + 1``: a band that widens by one diagonal on either side with every edit.

    ``reach[d]`` is how far into ``x`` so many edits get on the diagonal d.  Cheaper than a table where there are few edits for many words.
    """
    nx, ny, middle = len(x), len(y), limit + 1
    reach = np.full(2 * limit + 3, -2, np.int64)
    diagonals = np.arange(-middle, middle + 1)
    stop = np.minimum(nx, ny - diagonals)  # where a diagonal ends

    def run(i: int, d: int) -> int:
        """How far equal words go from i on the diagonal."""
        end, block = min(nx, ny - d), 32
        while i < end:
            to = min(end, i + block)
            differ = (x[i:to] != y[i + d : to + d]).argmax()
            if x[i + differ] != y[i + differ + d]:
                return i + int(differ)
            i, block = to, 2 * block
        return i

    reach[middle] = run(0, 0)
    for e in range(1, limit + 1):
        a, b = middle - min(e, nx), middle + min(e, ny) + 1
        new = np.maximum(reach[a:b], reach[a + 1 : b + 1])
        new += 1
        np.maximum(new, reach[a - 1 : b - 1], out=new)
        np.minimum(new, stop[a:b], out=new)
        d = diagonals[a:b]
        at = np.flatnonzero((new < stop[a:b]) & (new >= 0) & (new + d >= 0))
        at = at[x[new[at]] == y[new[at] + d[at]]]
        while len(at) > 4:
            new[at] += 1
            at = at[new[at] < stop[a:b][at]]
            at = at[x[new[at]] == y[new[at] + d[at]]]
        for k in at.tolist():
            new[k] = run(int(new[k]), int(d[k]))
        reach[a:b] = new
        if abs(ny - nx) <= e and reach[middle + ny - nx] >= nx:
            return e
    return limit + 1


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray) -> np.ndarray:
    """Edits between the word arrays of each pair, or its limit + 1 if there are more.

    Bands begin narrow and widen until they hold the alignment or reach the limit.
    """
    out = np.asarray(limits, np.int64) + 1
    limits, rest = out - 1, {}
    for k, (x, y) in enumerate(pairs):
        n = min(len(x), len(y))
        if max(len(x), len(y)) - n > limits[k]:
            continue
        differ = np.flatnonzero(x[:n] != y[:n])
        start = int(differ[0]) if len(differ) else n
        differ = np.flatnonzero(x[len(x) - n + start :][::-1] != y[len(y) - n + start :][::-1])
        stop = int(differ[0]) if len(differ) else n - start
        x, y = x[start : len(x) - stop], y[start : len(y) - stop]
        if len(x) > LONG and len(y):
            out[k] = _furthest(x, y, int(limits[k]))
        elif len(x) and len(y):
            rest[k] = (x, y)
        else:
            out[k] = min(out[k], max(len(x), len(y)))
    wide = NARROW
    while rest:
        ready = sorted((k for k, (x, y) in rest.items() if abs(len(x) - len(y)) <= wide), key=lambda k: (limits[k], len(rest[k][0])))
        at = 0
        while at < len(ready):
            to, most = at, 0
            while to < len(ready):  # pairs of like limits and lengths: as many as make ``CELLS``
                band, longest = min(wide, int(limits[ready[to]])), max(most, len(rest[ready[to]][0]))
                if to > at and max((to - at + 1) * (2 * band + 1) / CELLS, (to - at + 1) * 2 * (longest + band) / HELD_WORDS) > 1:
                    break
                to, most = to + 1, longest
            mine = ready[at:to]
            band = min(wide, int(limits[mine].max()))
            edits = _band([rest[k] for k in mine], band, np.minimum(limits[mine], band))
            for k, e in zip(mine, edits.tolist(), strict=True):
                if e <= band or band >= limits[k]:
                    out[k] = min(out[k], e)
                    del rest[k]
            at = to
        wide *= WIDER
    return out


def edit_distance(a: list[int], b: list[int], limit: int) -> int:
    """Edits between two word lists, or ``limit + 1`` if there are more."""
    return int(edit_distances([(np.asarray(a, np.uint32), np.asarray(b, np.uint32))], np.array([limit]))[0])


def _shared_enough(pairs: list[tuple[np.ndarray, np.ndarray]], limits: np.ndarray, width: int) -> np.ndarray:
    """Whether the pairs' runs of ``width`` words allow the limits: an edit changes ``width`` runs at most on either side."""
    owner, keys, side = [], [], []
    for s, texts in enumerate(zip(*pairs, strict=True)):
        size = np.array([len(t) for t in texts])
        runs = runs_hash(np.concatenate(texts).astype(np.uint64), width)
        count = np.maximum(size - width + 1, 0)
        keys.append(runs[ranges(np.cumsum(size) - size, count)] if len(runs) else runs)
        owner.append(np.repeat(np.arange(len(pairs)), count))
        side.append(np.full(len(owner[-1]), 1 - 2 * s))
    owner, side = np.concatenate(owner), np.concatenate(side)
    keyed = np.concatenate(keys) + mix((owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(keyed)
    keyed = keyed[order]
    first = np.flatnonzero(np.r_[True, keyed[1:] != keyed[:-1]]) if len(keyed) else np.empty(0, np.int64)
    more = np.add.reduceat(side[order], first) if len(first) else np.empty(0)
    own = owner[order[first]]
    extra = [np.bincount(own, weights=np.maximum(x, 0), minlength=len(pairs)) for x in (more, -more)]
    return np.maximum(*extra) <= width * np.asarray(limits)


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """1 - edits / longer length of each pair, or 0 if below ``least``."""
    longer = np.array([max(len(x), len(y)) for x, y in pairs], np.int64)
    limits = ((1 - least) * longer + 1e-9).astype(np.int64)
    out = np.zeros(len(pairs))
    left = np.arange(len(pairs))
    for width in (1, 2):
        if len(left):
            left = left[_shared_enough([pairs[i] for i in left], limits[left], width)]
    edits = edit_distances([pairs[i] for i in left], limits[left])
    ok = edits <= limits[left]
    left, edits = left[ok], edits[ok]
    out[left] = 1 - edits / np.maximum(longer[left], 1)
    return out


def similarity(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> float:
    """1 - edits / longer length, or 0 if below ``least``."""
    return float(similarities([(a, b)], least)[0])


def _parts(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PART_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text_key (hash of the text), text as bytes.  Id and text key together name a row."""
    text = text_or_empty(text_col)
    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.cast("binary").alias("text"))


def _row_key() -> Column:
    """The id, or where it is null the text's hash: so rows without an id don't meet in one task."""
    return F.coalesce("doc_id", "text_key")


def sketched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketches: int = SKETCHES) -> DataFrame:
    """doc_id, text_key, same (digest of the words), keys (a long for each sketch of its levels)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            for a, b in _parts(texts):
                mine = texts[a:b]
                same = [hashlib.md5(b" ".join(t.split())).digest() for t in mine]
                keys, n = sketch_keys(mine, sketches)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                columns = [*(batch.column(k).slice(a, b - a) for k in range(2)), pa.array(same, pa.binary()), pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64)))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text_key", "same", "keys"])

    return _rows(docs, id_col, text_col).mapInArrow(sketch, "doc_id long, text_key long, same binary, keys array<long>")


def _word_lists(texts: DataFrame) -> DataFrame:
    """Of (rep, text): rep, words: 32-bit word hashes as bytes; n: their number; bag: their counts by hash, at most 255, as bytes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _parts(texts):
                values, n = word_hashes(texts[a:b])
                short = (values >> np.uint64(32)).astype("<u4")
                ends = np.cumsum(n)
                bins = np.repeat(np.arange(b - a), n) * BINS + (short % np.uint32(BINS))
                bags = np.zeros((b - a) * BINS, np.uint8)
                at, count = np.unique(bins, return_counts=True)
                bags[at] = np.minimum(count, 255)
                bags = bags.reshape(b - a, BINS)
                words = [short[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(words, pa.binary()), pa.array(n, pa.int64()), pa.array([x.tobytes() for x in bags], pa.binary())], names=["rep", "words", "n", "bag"])

    return texts.mapInArrow(hashed, "rep long, words binary, n long, bag binary")


def _close_pairs(least: float):
    def close(table: pa.Table) -> pa.Table:
        """Pairs (a < b) of a shard's buckets, of different classes, whose lengths and counts of words allow ``least``.

        A pair is left to the first of the buckets that both members share: ``earlier`` holds a member's keys before this one.
        """
        key, low, high, block, rep, label, n = (table.column(c).to_numpy() for c in ("key", "low", "high", "block", "rep", "label", "n"))
        bag = np.frombuffer(b"".join(table.column("bag").to_pylist()), np.uint8).reshape(-1, BINS)
        lists = table.column("earlier").combine_chunks()
        values = lists.flatten().to_numpy()
        slot = values & ((1 << SLOT_BITS) - 1)
        earlier = np.zeros((len(key), int(slot.max(initial=0)) + 1), np.int64)
        earlier[np.repeat(np.arange(len(key)), np.diff(lists.offsets.to_numpy())), slot] = values
        order = np.lexsort((rep, n, high, low, key))
        key, low, high, block, rep, label, n, bag, earlier = (x[order] for x in (key, low, high, block, rep, label, n, bag, earlier))
        coarse = bag.reshape(-1, BINS // COARSE, COARSE).sum(1, dtype=np.int32)
        new = np.r_[True, (key[1:] != key[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]
        group = np.cumsum(new) - 1
        # members are in order of length: each meets those after it until they are too long
        longest = np.floor((n + 1e-6) / least).astype(np.int64)
        base = int(max(n.max(), longest.max())) + 2
        last = np.searchsorted(group * base + n, group * base + longest, side="right")
        after = np.maximum(last - np.arange(len(key)) - 1, 0)
        ends = np.cumsum(after)
        found = []
        at = 0
        while at < len(key):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, side="right")))
            a, b = np.repeat(np.arange(at, to), after[at:to]), ranges(np.arange(at + 1, to + 1), after[at:to])
            limit = ((1 - least) * n[b] + 1e-9).astype(np.int64)
            ok = (label[a] != label[b]) & ((low[a] == high[a]) | (block[a] != block[b])) & (n[b] - n[a] <= limit)
            a, b, limit = a[ok], b[ok], limit[ok]
            for held in (earlier[:, :8], earlier[:, 8:]):
                ok = np.empty(len(a), bool)
                for x in range(0, len(a), PAIRS // 64):
                    y = slice(x, x + PAIRS // 64)
                    one = held[a[y]]
                    ok[y] = ~((one == held[b[y]]) & (one != 0)).any(1)
                a, b, limit = a[ok], b[ok], limit[ok]
            for held, step in ((coarse, PAIRS // 8), (bag, PAIRS // 64)):
                ok = np.empty(len(a), bool)
                for x in range(0, len(a), step):
                    y = slice(x, x + step)
                    more = np.subtract(held[a[y]], held[b[y]], dtype=np.int16 if held is bag else np.int32)
                    # an edit changes each of both sums by one at most
                    ok[y] = np.maximum(np.maximum(more, 0).sum(1, dtype=np.int32), np.maximum(-more, 0).sum(1, dtype=np.int32)) <= limit[y]
                a, b, limit = a[ok], b[ok], limit[ok]
            pair = np.stack([rep[a], rep[b], label[a], label[b]], 1)
            turned = pair[:, 0] > pair[:, 1]
            pair[turned] = pair[turned][:, [1, 0, 3, 2]]
            found.append(pair)
            at = to
        pairs = np.concatenate([np.empty((0, 4), np.int64), *found])
        return pa.table([pa.array(pairs[:, k]) for k in range(4)], names=["a", "b", "label_a", "label_b"])

    return close


def _between_classes(members: DataFrame, labels: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(a, b): all pairs that share a bucket, are of different classes and may be similar."""
    named = spill(members.join(labels, "rep", "left").select("key", "rep", F.coalesce("label", "rep").alias("label")), "named")
    mixed = named.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y")
    mixed = spill(mixed.select("key", F.ceil(F.col("size") / BLOCK).cast("long").alias("blocks"), "size"), "mixed")
    rows = mixed.agg(F.sum(F.col("size") * F.col("blocks"))).first()[0] or 0
    mine = spill(named.join(mixed.drop("size"), "key"), "mine")
    # two members of different classes share mixed buckets only; a member has at most as many as it has sketches
    about = mine.groupBy("rep").agg(F.collect_list("key").alias("keys")).join(words.select("rep", "n", "bag"), "rep")
    dealt = mine.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    # every two blocks of a bucket meet once: a member goes where its block is the lower or the higher one
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("key", "low", "high"), F.lit(max(64, rows // SHARD_ROWS))))
    slot = (1 << SLOT_BITS) - 1
    earlier = F.filter("keys", lambda k: k.bitwiseAND(slot) < F.col("key").bitwiseAND(slot)).alias("earlier")
    dealt = dealt.join(about, "rep").select("shard", "key", "low", "high", "block", "rep", "label", "n", "bag", earlier)
    close = dealt.groupBy("shard").applyInArrow(_close_pairs(least), "a long, b long, label_a long, label_b long")
    return spill(close, "close")


def _verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) with their similarity, 0 where it is below ``least``."""

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [tuple(np.frombuffer(v.as_buffer(), "<u4") for v in two) for two in zip(batch.column(2), batch.column(3), strict=True)]
            size = np.cumsum([len(x) + len(y) for x, y in texts])
            cut = np.flatnonzero(np.diff(size // HELD_WORDS, prepend=0)).tolist()
            found = [similarities(texts[x:y], least) for x, y in zip([0, *cut], [*cut, len(texts)], strict=True) if x < y]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.concatenate([np.empty(0), *found]), pa.float64())], names=["a", "b", "similarity"])

    one = words.select(F.col("rep").alias("a"), F.col("words").alias("words_a"))
    two = words.select(F.col("rep").alias("b"), F.col("words").alias("words_b"))
    # a may be the first of a large group: the second join deals the pairs by b, which isn't
    with_words = pairs.join(one, "a").join(two.hint("merge"), "b").select("a", "b", "words_a", "words_b")
    return with_words.mapInArrow(align, "a long, b long, similarity double")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY, sketches: int = SKETCHES) -> tuple[DataFrame, DataFrame]:
    """A row for each document, and the verified links (a, b, similarity) between entries.

    A row has doc_id, text_key (``xxhash64`` of its text), class_id, copy_of (the smallest id with the same words), kept, and rep (the number of its
    entry, to which links refer).  How many links are verified depends on which members are compared first; classes don't.
    """
    sketch = spill(sketched(docs, id_col, text_col, sketches), "sketches")
    row = F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "text_key")
    entry = sketch.groupBy("same").agg(F.min(row).alias("first"), F.first("keys").alias("keys"))
    entry = spill(entry.withColumn("rep", F.monotonically_increasing_id()), "entries")
    at = entry.select("rep", F.explode("keys").alias("key"))
    shared = at.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = spill(at.join(spill(shared, "shared"), "key").select("key", "rep"), "members")
    involved = entry.join(members.select("rep").distinct(), "rep").select("rep", "first.doc_id", "first.text_key")
    involved = involved.select("rep", _row_key().alias("row_key"), F.col("text_key").alias("key_of_text"))
    source = _rows(docs, id_col, text_col).withColumn("row_key", _row_key())
    texts = source.join(involved, (source["row_key"] == involved["row_key"]) & (source["text_key"] == involved["key_of_text"])).select("rep", "text")
    words = spill(_word_lists(texts).dropDuplicates(["rep"]), "words")

    def classes_of(tested: DataFrame) -> DataFrame:
        return connected(tested.where(F.col("similarity") >= least), "a", "b").select(F.col("node").alias("rep"), "label")

    head = spill(members.groupBy("key").agg(F.min("rep").alias("a")), "heads")
    pairs = members.join(head, "key").select("a", F.col("rep").alias("b")).where("a <> b").distinct()
    tested = spill(_verified(pairs, words, least), "verified")
    labels = spill(classes_of(tested), "labels")
    close = _between_classes(members, labels, words, least)
    untested = spill(close.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "untested")
    # one pair for each two classes joins most that belong together; then all pairs that are still between classes
    one = untested.groupBy(F.least("label_a", "label_b"), F.greatest("label_a", "label_b")).agg(F.min(F.struct("a", "b")).alias("p")).select("p.a", "p.b")
    found = spill(_verified(one, words, least), "verified")
    tested = tested.unionByName(found)
    if not found.where(F.col("similarity") >= least).isEmpty():  # else the classes stay
        labels = spill(classes_of(tested), "labels")
    left, right = (labels.select(F.col("rep").alias(x), F.col("label").alias(f"now_{x}")) for x in "ab")
    rest = untested.select("a", "b").join(tested.select("a", "b"), ["a", "b"], "left_anti").join(left, "a", "left").join(right, "b", "left")
    rest = rest.where(F.coalesce("now_a", "a") != F.coalesce("now_b", "b")).select("a", "b")
    found = spill(_verified(rest, words, least), "verified")
    tested = tested.unionByName(found)
    if not found.where(F.col("similarity") >= least).isEmpty():
        labels = spill(classes_of(tested), "labels")
    links = tested.where(F.col("similarity") >= least)
    entries = entry.select("same", "rep", F.col("first.doc_id").alias("copy_of"), "first").join(labels, "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    stays = spill(entries.groupBy("label").agg(F.min("first").alias("stays")), "stays")
    entries = spill(entries.drop("first").join(stays, "label"), "classes")
    kept = F.col("doc_id").eqNullSafe(F.col("stays.doc_id")) & (F.col("text_key") == F.col("stays.text_key"))
    rows = sketch.select("doc_id", "text_key", "same").join(entries, "same")
    return rows.select("doc_id", "text_key", F.col("stays.doc_id").alias("class_id"), "copy_of", kept.alias("kept"), "rep"), links


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have a near-duplicate which stays."""
    rows, _ = near_duplicates(docs, id_col, text_col)
    return without(docs, rows.where(~F.col("kept")), id_col, text_col)


def near_digest(docs: DataFrame) -> DataFrame:
    """A row for each document: doc_id, class_id, copy_of, n_links (verified links of its text to other texts), kept."""
    rows, links = near_duplicates(docs)
    degree = spill(links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("n_links")), "degrees")
    return rows.join(degree, "rep", "left").select("doc_id", "class_id", "copy_of", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "kept")
