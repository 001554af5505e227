"""Sampled segmentations of whole texts over a public piece vocabulary, without replacement.

*Lattice.*  A text is a sequence of units: a run of spaces with the characters other than
white space (but for carriage returns) after it, a run of spaces without, or one other white-space character.  Every piece of
the vocabulary lies within a unit, those of several spaces and those that end in a carriage return too.  A unit's lattice has an edge for every piece of
the vocabulary (space written as U+2581); a character that is no piece is one edge, of its bytes' pieces.
A piece's log-probability follows Zipf's law in its rank, as the vocabulary's merge ranks aren't probabilities.
Sums over all suffix paths of a unit (computed once for a distinct unit of a chunk) turn edge weights into probabilities
of the next piece, so prefixes have exact probabilities.

*Sampling.*  Gumbel top-k: every segmentation has its log-probability plus Gumbel noise, and the k
largest are a sample without replacement.  A perturbed A* search finds them top down: a
prefix's bound is the largest perturbed value below it, which its best child inherits, while
other children get theirs conditional on that; the prefix with the best bound is expanded next,
and only the k + 1 best prefixes can matter.  All documents of a chunk take their steps together, in
numpy.  Below a prefix whose probability is under ``exp(-NEGLIGIBLE)`` the best segmentation is drawn by plain sampling, which is
its distribution, and the value of the second best given that: a Gumbel value of the prefix's other segmentations, under
the best one's.  Where it is among the k + 1 largest (about once in 1e13 prefixes) that segmentation is drawn too, and so on: the sample is exact for
any ``NEGLIGIBLE``.

*Inclusion.*  The (k+1)st value is the threshold t; a segmentation's log-inclusion score is
log(1 - exp(-exp(log_prob - t))), 0 if the text has at most k segmentations.

Noise depends on the row key, the number of the step and nothing else.  Null texts count as empty; an empty text has one
segmentation, of no pieces.  Repeated ids give equal rows for equal texts.  An empty table gives an empty result.
Decoding joins the pieces and gives back the text exactly.  Other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .textkit import NULL_ID, Numbers, mix, ranges

VOCABULARY = "piece_bpe_32k.model"
SAMPLES, LONGEST, NEGLIGIBLE = 2, 16, 32.0
#: Piece log-probabilities are multiplied by this (subword regularisation's alpha): the lower, the more varied the samples.
ALPHA = 0.2
#: What a slot of the lookup has instead of a piece: nothing, or only the beginning of pieces.
EMPTY, BEGINNING = -1, -2
PART_CHARS = 3 << 20
#: Characters of distinct units whose lattices a task keeps, at about 60 bytes each.
MOST_PLACES = 2 << 20
#: Characters of new units whose lattices are made at a time, so that their arrays stay in the processor's cache.
PLACES_AT_ONCE = 1 << 17
#: Units that are sampled at a time, so that their arrays stay in the processor's cache.
MOST_WALKS = 1 << 16
SPACE = "▁"
_UNIT = re.compile(r"[ ]*[\S\r]+|[ ]+|\s")
_P = np.uint64(0x9E3779B97F4A7C15)


class Pieces:
    """The vocabulary: piece lookup by hash, in numpy, and log-probabilities."""

    _flat: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(model.get_piece_size()) if model.is_byte(i)}
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], np.int32)
        self.text = {i: model.id_to_piece(i) for i in plain}
        self.byte_of = {i: b for b, i in self.byte_id.items()}
        #: Bytes that each piece stands for.
        self.bytes_of = {i: t.replace(SPACE, " ").encode() for i, t in self.text.items()} | {i: bytes([b]) for i, b in self.byte_of.items()}
        plain.sort(key=lambda i: -model.get_score(i))
        weight = 1.0 / np.arange(2, len(plain) + 2)
        total = weight.sum() + 256 * weight[-1]
        self.byte_log = ALPHA * float(np.log(weight[-1] / total))
        usable = [(i, w) for i, w in zip(plain, weight, strict=True) if len(self.text[i]) <= LONGEST]
        hashes = np.array([self.hash_of(self.text[i]) for i, _ in usable], np.uint64)
        begun = self._beginnings([self.text[i] for i, _ in usable])
        only_begun = np.setdiff1d(begun, hashes)
        # few enough slots for the processor's cache, at least half of them free
        self.bits = (2 * (len(hashes) + len(only_begun))).bit_length()
        self.slot_hash = np.zeros(1 << self.bits, np.uint64)
        self.slot_id = np.full(1 << self.bits, EMPTY, np.int32)
        self.slot_log = np.full(1 << self.bits, -np.inf, np.float32)
        for h, (i, w) in zip(hashes.tolist(), usable, strict=True):
            at = h >> (64 - self.bits)
            while self.slot_id[at] != EMPTY:
                at = (at + 1) % len(self.slot_id)
            self.slot_hash[at], self.slot_id[at], self.slot_log[at] = h, i, ALPHA * np.log(w / total)
        for h in only_begun.tolist():
            at = h >> (64 - self.bits)
            while self.slot_id[at] != EMPTY:
                at = (at + 1) % len(self.slot_id)
            self.slot_hash[at], self.slot_id[at] = h, BEGINNING

    @staticmethod
    def _beginnings(texts: list[str]) -> np.ndarray:
        """Hashes of all that the pieces begin with, and of the pieces."""
        found = set()
        for t in texts:
            h = 0
            for n, c in enumerate(t, 1):
                h = (h * int(_P) + ord(c) + 1) % 2**64
                found.add((h + n) % 2**64)
        return mix(np.fromiter(found, np.uint64, len(found)))

    @staticmethod
    def hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(_P) + ord(c) + 1) % 2**64
        return int(mix(np.array([h + len(piece)], np.uint64) if h + len(piece) < 2**64 else np.array([(h + len(piece)) % 2**64], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the hashes (of pieces, or of what pieces begin with), or free slots."""
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        left = np.flatnonzero((self.slot_hash[at] != h) & (self.slot_id[at] != EMPTY))
        while len(left):
            at[left] = slot = (at[left] + 1) % len(self.slot_id)
            left = left[(self.slot_hash[slot] != h[left]) & (self.slot_id[slot] != EMPTY)]
        return at

    def decoded_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that an array of ids stands for, and how many each has."""
        if self._flat is None:
            held = [self.bytes_of.get(i, b"") for i in range(max(self.bytes_of) + 1)]
            size = np.fromiter(map(len, held), np.int64, len(held))
            self._flat = np.frombuffer(b"".join(held), np.uint8), np.cumsum(size) - size, size
        flat, start, size = self._flat
        sizes = size[ids]
        return flat[ranges(start[ids], sizes)], sizes

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class Lattices:
    """Lattices of distinct units: the edges at every place, with their probabilities.

    Edges of a place lie together, the likeliest first: ``first`` by unit; ``end``, ``code``, ``offset`` and ``n_edges`` by place;
    ``piece``, ``span``, ``cumulative`` and ``edge_log`` by edge.  A task keeps them for the units of its next texts (``numbers``)
    until they have ``MOST_PLACES``; then it begins again.
    """

    BY_PLACE, BY_EDGE = ("end", "code", "offset", "n_edges"), ("piece", "span", "cumulative", "edge_log")

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.reset()

    def reset(self) -> None:
        self.index = Numbers()
        self.first, self.end, self.offset = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.code, self.n_edges, self.piece, self.span = np.empty(0, np.uint32), np.empty(0, np.uint8), np.empty(0, np.int32), np.empty(0, np.uint8)
        self.cumulative, self.edge_log = np.empty(0, np.float32), np.empty(0, np.float32)

    def numbers(self, units: list[str]) -> np.ndarray:
        """The units' numbers; lattices are made for those that have none."""
        if len(self.code) > MOST_PLACES:
            self.reset()
        out = np.fromiter(map(self.index.__getitem__, units), np.int64, len(units))
        if self.index.fresh:
            fresh = self.index.taken()
            places, edges = len(self.code), len(self.piece)
            grown = {name: [getattr(self, name)] for name in ("first", *self.BY_PLACE, *self.BY_EDGE)}
            for a, b in _runs(np.fromiter(map(len, fresh), np.int64, len(fresh)), PLACES_AT_ONCE):
                first, made = _lattices(fresh[a:b], self.pieces)
                made["end"] += places
                made["offset"] += edges
                made["first"] = first + np.int32(places)
                places, edges = places + len(made["code"]), edges + len(made["piece"])
                for name, value in made.items():
                    grown[name].append(value)
            for name in list(grown):
                setattr(self, name, np.concatenate(grown.pop(name)))
        return out


def _lattices(units: list[str], pieces: Pieces) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Where each unit starts, and the arrays of :class:`Lattices` for these units."""
    size = np.fromiter(map(len, units), np.int32, len(units))
    first = np.cumsum(size, dtype=np.int32) - size
    end = np.repeat(first + size, size)
    own = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    n = len(own)
    # the space that pieces write as U+2581 is matched as such; a real U+2581 by its bytes
    code = np.where(own == 32, np.uint32(ord(SPACE)), np.where(own == ord(SPACE), np.uint32(0), own)).astype(np.uint64)
    code += np.uint64(1)
    left = end - np.arange(n, dtype=np.int32)
    n_edges = np.zeros(n, np.uint8)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]] = []
    running, at = np.zeros(n, np.uint64), np.arange(n, dtype=np.int32)
    for k in range(LONGEST):
        if k:
            # longer pieces begin with what is found so far
            keep = np.flatnonzero((number != EMPTY) & (left[at] > k))
            at, running = at[keep], running[keep]
            if not len(at):
                break
        running *= _P
        running += code[at + np.int32(k)]
        slot = pieces.find(mix(running + np.uint64(k + 1)))
        number = pieces.slot_id[slot]
        ok = number >= 0
        hit = at[ok]
        found.append((hit, number[ok], pieces.slot_log[slot[ok]], k + 1))
        n_edges[hit] += np.uint8(1)
        if k == 0:
            lone = at[~ok]
            n_bytes = 1 + (own[lone] >= 0x80).astype(int) + (own[lone] >= 0x800) + (own[lone] >= 0x10000)
            # one byte: its piece; more: -2, replaced at the end
            piece = np.where(own[lone] < 0x80, pieces.byte_ids[np.minimum(own[lone], 0x7F)], -2).astype(np.int32)
            found.append((lone, piece, (pieces.byte_log * n_bytes).astype(np.float32), 1))
            n_edges[lone] += np.uint8(1)
    offset = np.cumsum(n_edges, dtype=np.int32) - n_edges.astype(np.int32)
    n_all = int(n_edges.sum(dtype=np.int64))
    piece, log, span = np.empty(n_all, np.int32), np.empty(n_all, np.float32), np.empty(n_all, np.uint8)
    used = offset.copy()
    for p, i, w, k in found:
        e = used[p]
        piece[e], log[e], span[e] = i, w, k
        used[p] += 1
    place = np.repeat(np.arange(n, dtype=np.int32), n_edges)
    target = place + span
    inner = target < end[place]
    target[~inner] = n  # whose sum stays 0
    # sums over suffix paths, from the ends of all units together
    total = np.zeros(n + 1)
    by_left = np.argsort(left.astype(np.uint16) if n and left.max() < 1 << 16 else left, kind="stable")
    cut = np.searchsorted(left[by_left], np.arange(1, int(left.max(initial=0)) + 2))
    size_by_left = n_edges[by_left].astype(np.int64)
    edge = ranges(offset[by_left].astype(np.int64), size_by_left)
    log_by_left, target_by_left = log[edge], target[edge]
    start = np.concatenate([[0], np.cumsum(size_by_left)])
    del edge
    for a, b in zip(cut.tolist(), cut[1:].tolist(), strict=False):
        if a == b:
            continue
        x, y = start[a], start[b]
        starts = start[a:b] - x
        value = total[target_by_left[x:y]]
        value += log_by_left[x:y]
        top = np.maximum.reduceat(value, starts)
        value -= np.repeat(top, size_by_left[a:b])
        total[by_left[a:b]] = top + np.log(np.add.reduceat(np.exp(value, out=value), starts))
    edge_log = total[target]
    edge_log += log
    edge_log -= total[place]
    del log_by_left, target_by_left, target
    share = np.exp(edge_log)
    if n:
        # the likeliest edge first
        best = np.flatnonzero(share == np.maximum.reduceat(share, offset)[place])
        best = best[np.r_[True, place[best[1:]] != place[best[:-1]]]]
        moved = np.flatnonzero(best != offset)
        top, best = offset[moved], best[moved]
        for x in (piece, span, share, edge_log):
            x[top], x[best] = x[best], x[top]
    running_sum = np.cumsum(share)
    before = running_sum[offset] - share[offset]
    running_sum -= before[place]
    cumulative = running_sum.astype(np.float32)
    cumulative[offset + n_edges - 1] = 2.0  # rounding must not choose an edge that isn't there
    return first, {"end": end, "code": own, "offset": offset, "n_edges": n_edges, "piece": piece, "span": span, "cumulative": cumulative, "edge_log": edge_log.astype(np.float32)}


def _uniform(h: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) from 64-bit values."""
    return ((mix(h) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _search(lattice: Lattices, unit: np.ndarray, begin: np.ndarray, count: np.ndarray, key: np.ndarray, k: int):
    """The k best prefixes of each document: bound, log-probability, unit reached, place in it, number of the last step; and the steps' edges and the numbers of the steps before them (-1: none)."""
    n = len(count)
    bound = np.full((n, k), -np.inf)
    prob = np.zeros((n, k))
    at_unit = np.zeros((n, k), np.int64)
    place = np.full((n, k), -1, np.int64)
    last = np.full((n, k), -1, np.int64)
    bound[:, 0] = -np.log(-np.log(_uniform(key)))
    full = count > 0
    place[full, 0] = lattice.first[unit[begin[full]]]
    done = np.zeros((n, k), bool)
    done[:, 1:] = True
    done[~full] = True
    trail: list[tuple[np.ndarray, np.ndarray]] = []
    n_trail = step = 0
    rows = np.flatnonzero(full)
    while len(rows):
        nth_row = np.arange(len(rows))
        old = bound[rows]
        node = np.where(done[rows], -np.inf, old).argmax(1)
        at = rows * k + node
        g, p, u = old[nth_row, node], place.ravel()[at], at_unit.ravel()[at]
        # the edges of all these places, one after the other
        size = lattice.n_edges[p].astype(np.int64)
        start = np.cumsum(size) - size
        owner = np.repeat(nth_row, size)
        nth = np.arange(len(owner)) - start[owner]
        edge = lattice.offset[p][owner] + nth
        child = prob.ravel()[at][owner] + lattice.edge_log[edge]
        h = key[rows][owner] + (np.uint64(step) * np.uint64(64) + np.uint64(1) + nth.view(np.uint64)) * _P
        noisy = child - np.log(-np.log(_uniform(h)))
        with np.errstate(divide="ignore", over="ignore"):
            # the children's bounds, given that the best of them is the parent's
            v = g[owner] - noisy + np.log1p(-np.exp(noisy - np.maximum.reduceat(noisy, start)[owner]))
            fresh = g[owner] - np.maximum(v, 0) - np.log1p(np.exp(-np.abs(v)))
        old[nth_row, node] = -np.inf
        every = np.full((len(rows), k + int(size.max())), np.inf)
        every[:, :k] = -old
        every[owner, nth + k] = -fresh
        best = np.argsort(every, axis=1, kind="stable")[:, :k]
        new_bound = -every[nth_row[:, None], best]
        is_new = best >= k
        source = rows[:, None] * k + np.where(is_new, node[:, None], best)
        new_prob, to, to_unit, new_last, new_done = (x.ravel()[source] for x in (prob, place, at_unit, last, done))
        r, column = np.nonzero(is_new)
        which = start[r] + best[r, column] - k
        chosen, reached, reached_unit = edge[which], p[r], u[r]
        ends = lattice.end[reached]
        reached = reached + lattice.span[chosen]
        ended = reached == ends
        reached_unit = reached_unit + ended
        over = reached_unit >= count[rows[r]]
        onward = np.flatnonzero(ended & ~over)
        reached[onward] = lattice.first[unit[begin[rows[r[onward]]] + reached_unit[onward]]]
        trail.append((chosen, new_last[r, column]))
        new_prob[r, column], to[r, column], to_unit[r, column] = child[which], reached, reached_unit
        new_last[r, column] = n_trail + np.arange(len(r))
        n_trail += len(r)
        new_done[r, column] = over | (child[which] < -NEGLIGIBLE)
        new_done |= np.isneginf(new_bound)
        bound[rows], prob[rows], at_unit[rows], place[rows], last[rows], done[rows] = new_bound, new_prob, to_unit, to, new_last, new_done
        rows = rows[~new_done.all(1)]
        step += 1
    edges, before = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*trail, strict=True) if trail else ((), ())))
    return bound, prob, at_unit, place, last, edges, before


def _walks(lattice: Lattices, place: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of plain samples from the places to the ends of their units, and how many each has; noise depends on the seeds."""
    taken: list[tuple[np.ndarray, np.ndarray]] = []
    n_steps = np.zeros(len(place), np.int64)
    active, at, end = np.arange(len(place)), place, lattice.end[place]
    while len(active):
        r = _uniform(seed + np.uint64(len(taken))).astype(np.float32)
        edge = lattice.offset[at]
        more = np.flatnonzero(lattice.cumulative[edge] <= r)
        while len(more):
            edge[more] += 1
            more = more[lattice.cumulative[edge[more]] <= r[more]]
        taken.append((active, edge))
        n_steps[active] = len(taken)
        at = at + lattice.span[edge]
        left = np.flatnonzero(at < end)
        active, at, end, seed = active[left], at[left], end[left], seed[left]
    offset = np.cumsum(n_steps) - n_steps
    edges = np.empty(int(n_steps.sum()), np.int32)
    for t, (a, e) in enumerate(taken):
        edges[offset[a] + t] = e
    return edges, n_steps


def sample_segmentations(texts: list[str], keys: np.ndarray, pieces: Pieces, k: int = SAMPLES, lattice: Lattices | None = None) -> list[tuple[int, int, float, float, float, np.ndarray]]:
    """(text, rank, log_prob, value, log_inclusion, ids) of up to k segmentations a text."""
    split = [_UNIT.findall(t) for t in texts]
    lattice = lattice or Lattices(pieces)
    count = np.array([len(x) for x in split], np.int64)
    unit = lattice.numbers(list(chain.from_iterable(split)))
    del split
    begin = np.cumsum(count) - count
    key = mix(keys.astype(np.int64).view(np.uint64) + _P)
    bound, prob, at_unit, place, last, trail, before = _search(lattice, unit, begin, count, key, k + 1)
    order = np.argsort(-bound, axis=1, kind="stable")
    rows, ranks = np.nonzero(~np.isneginf(np.take_along_axis(bound, order, 1))[:, :k])
    node = order[rows, ranks]
    value, log_prob = bound[rows, node], prob[rows, node]
    # the prefix's edges, from the last to the first
    heads: list[tuple[np.ndarray, np.ndarray]] = []
    n_head = np.zeros(len(rows), np.int64)
    at = last[rows, node]
    active = np.flatnonzero(at >= 0)
    while len(active):
        heads.append((active, trail[at[active]]))
        n_head[active] = len(heads)
        at[active] = before[at[active]]
        active = active[at[active] >= 0]
    # the rest of each prefix is plain sampling, unit by unit, for some prefixes at a time
    u = at_unit[rows, node]
    rest = np.maximum(count[rows] - u, 0)
    seed = mix(key[rows] + (ranks.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    walks = [np.empty(0, np.int32)]
    n_walk = np.zeros(len(rows), np.int64)
    for a, b in _runs(rest, MOST_WALKS):
        owner = np.repeat(np.arange(a, b), rest[a:b])
        nth = ranges(u[a:b], rest[a:b])
        p = lattice.first[unit[begin[rows[owner]] + nth]]
        some = np.flatnonzero(rest[a:b])
        p[(np.cumsum(rest[a:b]) - rest[a:b])[some]] = place[rows[a:b], node[a:b]][some]
        edges, n_steps = _walks(lattice, p, seed[owner] + nth.astype(np.uint64) * np.uint64(1 << 20))
        walks.append(edges)
        n_walk[a:b] = np.bincount(owner - a, weights=n_steps, minlength=b - a)
    walked = np.concatenate(walks)
    del walks
    bounds = np.concatenate([[0], np.cumsum(n_walk)])
    added = np.zeros(len(rows))
    some = np.flatnonzero(n_walk)
    if len(some):
        added[some] = np.add.reduceat(lattice.edge_log[walked].astype(np.float64), bounds[some])
    log_prob += added
    edges = np.empty(len(walked) + int(n_head.sum()), np.int32)
    is_head = np.zeros(len(edges), bool)
    first = bounds[:-1] + np.cumsum(n_head) - n_head
    for t, (active, found) in enumerate(heads, 1):
        at = first[active] + n_head[active] - t
        edges[at] = found
        is_head[at] = True
    edges[~is_head] = walked
    every = np.append(first, len(edges))
    ids, ends = _ids(lattice, pieces, edges, every)
    threshold = bound[np.arange(len(bound)), order[:, min(k, order.shape[1] - 1)]]
    # values of the second best segmentations below the prefixes
    second = _next_value(prob[rows, node], -np.expm1(np.minimum(added, 0.0)), value, _uniform(key[rows] + (ranks.astype(np.uint64) + np.uint64(1)) * np.uint64(0xA0761D6478BD642F)))
    parts = [ids[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist(), strict=False)]
    out = list(zip(rows.tolist(), ranks.tolist(), log_prob.tolist(), value.tolist(), _inclusion(log_prob, threshold[rows]).tolist(), parts, strict=True))
    again = {int(i): [] for i in rows[(rest > 0) & (second > threshold[rows])]}
    if not again:
        return out
    for s in np.flatnonzero(np.isin(rows, list(again))).tolist():
        i, rank, total, top, _, mine = out[s]
        head, walk = edges[first[s] : first[s] + n_head[s]].tolist(), edges[first[s] + n_head[s] : every[s + 1]].tolist()
        more = None if not rest[s] else Below(lattice, unit[begin[i] + u[s] : begin[i] + count[i]], int(place[i, node[s]]), float(prob[i, node[s]]), head, [walk], float(second[s]), int(key[i]) + rank)
        again[i].append((top, total, mine, more))
    out = [x for x in out if x[0] not in again]
    for i, found in again.items():
        found, least = _with_others(found, float(threshold[i]), k, pieces)
        out += [(i, rank, log, top, float(_inclusion(np.float64(log), np.float64(least))), mine) for rank, (top, log, mine) in enumerate(found)]
    return sorted(out, key=itemgetter(0, 1))


def _runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of about ``most`` by their sizes' sum, one size at least in each."""
    ends = np.cumsum(sizes)
    first = 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + most, side="right")))
        yield first, last
        first = last


def _inclusion(log_prob: np.ndarray, threshold: np.ndarray) -> np.ndarray:
    x = log_prob - threshold
    with np.errstate(divide="ignore"):
        return np.where(np.isneginf(threshold), 0.0, np.where(x < -30, x, np.log(-np.expm1(-np.exp(np.clip(x, -40.0, 30.0))))))


def _ids(lattice: Lattices, pieces: Pieces, edges: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids along paths of edges, which lie between ``bounds``; and the bounds of their ids."""
    ids = lattice.piece[edges]
    others = np.flatnonzero(ids == -2)
    if not len(others):
        return ids, bounds
    chars = lattice.code[np.searchsorted(lattice.offset, edges[others], side="right") - 1]
    size = np.ones(len(ids), np.int64)
    size[others] = 2 + (chars >= 0x800).astype(np.int64) + (chars >= 0x10000)
    ids = np.repeat(ids, size)
    ids[ids == -2] = pieces.byte_ids[np.frombuffer("".join(map(chr, chars.tolist())).encode(), np.uint8)]
    return ids, np.concatenate([[0], np.cumsum(size)])[bounds]


def _next_value(log_prob: np.ndarray, left: np.ndarray, top: np.ndarray, r: np.ndarray) -> np.ndarray:
    """The largest perturbed value of the share ``left`` of a prefix's segmentations, given that it is under ``top``; ``r``: uniform noise."""
    with np.errstate(divide="ignore", over="ignore", invalid="ignore"):
        value = -np.logaddexp(-top, np.log(-np.log(r)) - log_prob - np.log(np.maximum(left, 0.0)))
    return np.where(left > 0, value, -np.inf)


class Below:
    """The segmentations below a prefix that are not drawn yet, and the largest perturbed value among them."""

    def __init__(self, lattice: Lattices, units: np.ndarray, place: int, log_prob: float, head: list[int], drawn: list[list[int]], value: float, seed: int):
        self.lattice, self.place, self.log_prob, self.head, self.value = lattice, place, log_prob, head, value
        self.firsts, self.drawn, self.rng = lattice.first[units].tolist(), {tuple(x) for x in drawn}, np.random.default_rng(seed % 2**64)
        if len(self.drawn) == self.ways():
            self.value = -np.inf

    def ways(self) -> int:
        """How many segmentations there are below the prefix."""
        total = 1
        for place in (self.place, *self.firsts[1:]):
            end = int(self.lattice.end[place])
            to_end = {end: 1}
            for p in range(end - 1, place - 1, -1):
                e = int(self.lattice.offset[p])
                to_end[p] = sum(to_end[p + int(n)] for n in self.lattice.span[e : e + int(self.lattice.n_edges[p])])
            total *= to_end[place]
        return total

    def draw(self) -> tuple[float, float, list[int]]:
        """The next segmentation: its value, its log-probability and its edges; the value of the one after it is drawn, too."""
        while True:
            edges = []
            for place in (self.place, *self.firsts[1:]):
                p, end = place, int(self.lattice.end[place])
                while p < end:
                    e, n = int(self.lattice.offset[p]), int(self.lattice.n_edges[p])
                    e += min(n - 1, int(np.searchsorted(self.lattice.cumulative[e : e + n], self.rng.random(), side="right")))
                    edges.append(e)
                    p += int(self.lattice.span[e])
            if tuple(edges) not in self.drawn:
                break
        value = self.value
        self.drawn.add(tuple(edges))
        left = 1.0 - sum(math.exp(self._log(x)) for x in self.drawn)
        self.value = -math.inf if len(self.drawn) == self.ways() else float(_next_value(self.log_prob, max(left, 1e-12), value, self.rng.random()))
        return value, self.log_prob + self._log(edges), [*self.head, *edges]

    def _log(self, edges: Iterable[int]) -> float:
        return float(self.lattice.edge_log[list(edges)].astype(np.float64).sum())


def _with_others(found: list[tuple], threshold: float, k: int, pieces: Pieces) -> tuple[list[tuple], float]:
    """The k best segmentations and the (k+1)st value of those ``found`` (value, log_prob, ids, what else is below the prefix) and all below their prefixes."""
    done = [f[:3] for f in found]
    below = [f[3] for f in found if f[3] is not None]
    while below:
        best = max(below, key=lambda x: x.value)
        if np.isneginf(best.value) or sum(f[0] > best.value for f in done) + (threshold > best.value) > k:
            break
        if sum(f[0] > best.value for f in done) + (threshold > best.value) == k:
            threshold = best.value  # only its value counts
            break
        value, log_prob, edges = best.draw()
        done.append((value, log_prob, _ids(best.lattice, pieces, np.array(edges, np.int64), np.array([0, len(edges)]))[0]))
    done.sort(key=itemgetter(0), reverse=True)
    return done[:k], max([threshold, *(f[0] for f in done[k:])])


_loaded: dict[str, Pieces] = {}


def worker_pieces(path: str | None = None) -> Pieces:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(VOCABULARY)
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= PART_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def _decodes(ids: list[np.ndarray], texts: list[str], pieces: Pieces) -> list[bool]:
    """Whether each array of ids gives its text."""
    out = []
    for a, b in _runs(np.fromiter(map(len, ids), np.int64, len(ids)), MOST_WALKS):
        found, sizes = pieces.decoded_bytes(np.concatenate(ids[a:b]))
        ends = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, ids[a:b])])].tolist()
        whole = found.tobytes()
        out += [whole[x:y] == t.encode() for x, y, t in zip(ends, ends[1:], texts[a:b], strict=False)]
    return out


def segmentations(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, rank (from 1), log_prob, perturbed, log_inclusion, n_pieces, ids_crc32, decodes (and ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path)
        lattice = Lattices(pieces)
        for batch in batches:
            all_ids = batch.column(0)
            keys = all_ids.fill_null(NULL_ID).to_numpy(zero_copy_only=False)
            texts = batch.column(1).to_pylist()
            for a, b in _parts(texts):
                found = sample_segmentations(texts[a:b], keys[a:b], pieces, k, lattice)
                columns = {
                    "doc_id": all_ids.take(pa.array([a + f[0] for f in found], pa.int64())),
                    "rank": pa.array([f[1] + 1 for f in found], pa.int32()),
                    "log_prob": pa.array([f[2] for f in found], pa.float64()),
                    "perturbed": pa.array([f[3] for f in found], pa.float64()),
                    "log_inclusion": pa.array([f[4] for f in found], pa.float64()),
                    "n_pieces": pa.array([len(f[5]) for f in found], pa.int64()),
                    "ids_crc32": pa.array([zlib.crc32(f[5].astype("<u4")) for f in found], pa.int64()),
                    "decodes": pa.array(_decodes([f[5] for f in found], [texts[a + f[0]] for f in found], pieces), pa.bool_()),
                }
                if with_ids:
                    ends = np.cumsum([0, *(len(f[5]) for f in found)])
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([f[5] for f in found]), pa.int32()))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, rank int, log_prob double, perturbed double, log_inclusion double, n_pieces long, ids_crc32 long, decodes boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def decoded(segments: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, rank, text: the texts of segmentations with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = worker_pieces(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([pieces.decode(x) for x in batch.column(2).to_pylist()], pa.string())], names=["doc_id", "rank", "text"])

    return segments.select("doc_id", "rank", "ids").mapInArrow(run, "doc_id long, rank int, text string")
