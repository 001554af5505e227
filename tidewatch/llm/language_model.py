"""Scores of whole documents by counts and by a gated recurrent language model.

*Counts.*  Tokens are words (A-Z lower-cased) and one end for each document.  Each chunk sends
its distinct words with their training counts to buckets by hash; a bucket sums them and
answers each chunk with the totals of its words, so every document's base score follows from counts over all training documents.
A text is read once: later steps see it as ordinals of its chunk's words, then as symbols of the model.

*Model.*  A gated recurrent unit in numpy reads the words one by one.  The vocabulary of the model is
the ``VOCABULARY`` most frequent training words that occur twice or more; others share one symbol, whose words are told
apart by their counts.  The output softmax is factored: log p(word) = log p(class) + log p(word | class).  A token costs as many
outputs as there are classes, and as there are words in its own.  The expected sum is least for classes of neighbours in frequency with equal sums of
the square roots of their words' shares, and as many classes as that sum over all words: frequent words have small classes.  Training is truncated backpropagation through time over windows
of ``WINDOW`` tokens or more, with the state carried from a document's first token to its end.  Chunks of documents are dealt over
shards of about ``SHARD_TOKENS``, as many as the data ask for.  In every
round a copy of the weights learns from all tokens of each shard's training documents, and the copies are averaged, weighed by
their tokens, so scores don't depend (but for rounding) on how Spark partitions.  Documents lie one after the other in the rows of a batch, the longest of a shard first; it
gets more rows as a task goes on, and longer windows where few rows are left.
Scoring carries the state over the whole document.

Null texts count as empty (one token, the end).  Repeated ids give a row each.  Without training
documents all counts are 0 and the model keeps its first weights.  An empty table gives an empty result.  Other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces_for, spill, text_bytes
from .textkit import NULL_ID, chunked, in_order, packed, unpacked, word_hashes

VOCABULARY, EMBED, HIDDEN = 32768, 16, 16
WINDOW, SPAN, ROUNDS, RATE = 16, 16, 1, 0.02
#: Rows of a batch: at least, at most, and tokens learnt for each row in between.
FEWEST, BATCH, TOKENS_A_ROW = 512, 1024, 1024
#: States whose class outputs are computed together: they stay in the cache.
BLOCK = 1024
#: Training tokens that one copy of the weights learns from, about; copies that are averaged at once.
SHARD_TOKENS, FAN = 1 << 20, 16
#: Text bytes for each bucket of words.
BUCKET_BYTES = 27 << 20
ONES = np.ones(VOCABULARY, np.float32)
END = 0x5EED5EED5EED5EED
#: Bytes A-Z to a-z.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
COUNTED = "bucket int, chunk int, n int, words binary, counts binary, n_docs int, ids binary, nulls binary, sizes binary, ordinals binary"
TOTALS = "chunk int, n int, words binary, counts binary"
CODED = "chunk int, n int, n_docs int, ids binary, nulls binary, sizes binary, known binary, base binary, extra binary, symbols binary"
SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


def held_out(ids: np.ndarray, nulls: np.ndarray, parts: int = 5, rest: int = 1) -> np.ndarray:
    return np.array([not z and zlib.crc32(str(i).encode()) % parts == rest for i, z in zip(ids.tolist(), nulls.tolist(), strict=True)], bool)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, an end after each text's words, and the number of tokens of each text."""
    words, n = word_hashes([t.translate(LOWER) for t in texts])
    ends = np.cumsum(n)
    return np.insert(words, ends, np.uint64(END)), n + 1


class Model:
    """Weights of the recurrent model, as a dict of float32 arrays, and its steps."""

    def __init__(self, first: np.ndarray, log_class: np.ndarray, log_word: np.ndarray):
        """``first``: places of the classes' first words, and the end.  Biases start at the counts' log-probabilities: of classes, and of words in them."""
        rng = np.random.default_rng(7)
        n_class = len(log_class)
        self.first = first
        scale = 0.3
        self.w = {
            "embed": rng.normal(0, scale, (len(log_word), EMBED)),
            "in": rng.normal(0, scale, (EMBED, 3 * HIDDEN)),
            "state": rng.normal(0, scale, (HIDDEN, 3 * HIDDEN)),
            "gate": np.zeros((1, 3 * HIDDEN)),
            # the last weight of a class or word is its bias
            "class": np.concatenate([rng.normal(0, 0.01, (HIDDEN, n_class)), log_class[None]]),
            "word": np.concatenate([rng.normal(0, 0.01, (len(log_word), HIDDEN)), log_word[:, None]], 1),
        }
        self.w = {k: v.astype(np.float32) for k, v in self.w.items()}

    @staticmethod
    def step(w: dict, x: np.ndarray, h: np.ndarray, keep: list | None = None) -> np.ndarray:
        """One step of the gated unit; ``x``: the tokens' rows of embed @ in + gate."""
        a = h @ w["state"]
        zr = x[:, : 2 * HIDDEN] + a[:, : 2 * HIDDEN]
        np.negative(zr, out=zr)
        np.exp(zr, out=zr)
        zr += 1
        np.reciprocal(zr, out=zr)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        c = r * a[:, 2 * HIDDEN :]
        c += x[:, 2 * HIDDEN :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((h, z, r, c, a[:, 2 * HIDDEN :]))
        after = c - h
        after *= z
        after += h
        return after

    @staticmethod
    def shares(h: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """exp of the states' outputs (the states' last column is 1, for the bias), and their sums."""
        out = h @ weights
        np.exp(out, out=out)
        return out, out @ ONES[: out.shape[1]]

    def by_class(self, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int, int]]]:
        """An order of the targets by class, their classes in that order, and for each class of several words that occurs:
        its first word, its end, its first place in the order, the end of its places."""
        order = np.argsort(target.astype(np.uint16) if self.first[-1] <= 1 << 16 else target, kind="stable")
        cut = np.searchsorted(target[order], self.first)
        several = np.flatnonzero((np.diff(cut) > 0) & (np.diff(self.first) > 1))
        bounds = np.stack([self.first[several], self.first[several + 1], cut[several], cut[several + 1]], 1).tolist()
        return order, np.repeat(np.arange(len(self.first) - 1), np.diff(cut)), bounds

    def log_probs(self, h: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of the targets given the states before them."""
        w = self.w
        order, of_class, bounds = self.by_class(target)
        h = np.concatenate([h, np.ones((len(h), 1), np.float32)], 1).astype(np.float32, copy=False)[order]
        y, share = target[order], np.empty(len(h), np.float32)
        for a in range(0, len(h), BLOCK):
            b = min(len(h), a + BLOCK)
            out, total = self.shares(h[a:b], w["class"])
            share[a:b] = out[np.arange(b - a), of_class[a:b]] / total
        for low, high, a, b in bounds:  # a matrix product for each class
            out, total = self.shares(h[a:b], w["word"][low:high].T)
            share[a:b] *= out[np.arange(b - a), y[a:b] - low] / total
        found = np.empty(len(h), np.float32)
        found[order] = np.log(np.maximum(share, np.float32(1e-37)))
        return found

    def train(self, inputs: np.ndarray, targets: np.ndarray, valid: np.ndarray, h: np.ndarray, memory: dict, rate: float, fresh: np.ndarray | None = None) -> np.ndarray:
        """One window, (batch, steps): a step of gradient ascent scaled by running squares.  The state after it.

        Where ``fresh`` is set a document starts, with a state of zero.  Embeddings that don't occur in
        the window stay as they are.
        """
        w, (rows, steps) = self.w, inputs.shape
        if "word" not in memory:
            memory |= {k: np.zeros(v.shape[:-1], np.float32) for k, v in w.items()}
        x = inputs.T.ravel()
        by = np.argsort(x.astype(np.uint16) if len(w["embed"]) <= 1 << 16 else x, kind="stable")
        x = x[by]
        first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])  # of each symbol's places in that order
        seen, at = x[first], np.empty(len(x), np.int64)
        at[by] = np.repeat(np.arange(len(seen)), np.diff(np.r_[first, len(x)]))
        embedded = w["embed"][seen]
        projected = (embedded @ w["in"] + w["gate"])[at].reshape(steps, rows, -1)
        kept: list[tuple] = []
        every = np.ones((steps, rows, HIDDEN + 1), np.float32)
        going = None if fresh is None or not fresh.any() else np.float32(1) - fresh.T.astype(np.float32)[:, :, None]
        for t in range(steps):
            if going is not None:
                h = h * going[t]
            h = self.step(w, projected[t], h, kept)
            every[t, :, :HIDDEN] = h
        # the outputs of all steps together: they don't depend on each other
        ok = np.flatnonzero(valid.T.ravel())
        whole = len(ok) == rows * steps
        s, y = every.reshape(-1, HIDDEN + 1), targets.T.ravel()
        if not whole:
            s, y = s[ok], y[ok]
        order, of_class, bounds = self.by_class(y)
        ok, s, y = ok[order], s[order], y[order]
        grad = {k: np.zeros_like(w[k]) for k in ("in", "state", "gate", "class", "word")}
        down = np.empty((len(s), HIDDEN), np.float32)
        back_class = np.ascontiguousarray(w["class"][:HIDDEN].T)
        for a in range(0, len(s), BLOCK):
            b = min(len(s), a + BLOCK)
            # the gradient of the outputs is d * part: the narrow factors are scaled
            d, total = self.shares(s[a:b], w["class"])
            d[np.arange(b - a), of_class[a:b]] -= total
            part = (np.float32(-1) / total)[:, None]
            grad["class"] += (s[a:b] * part).T @ d
            np.matmul(d, back_class, out=down[a:b])
            down[a:b] *= part
        weigh = np.float32(rows / max(1, len(ok)))
        # likewise, with what is scaled in arrays for all classes
        own, scaled, parts, nth = np.zeros_like(down), np.empty_like(s), np.zeros((len(s), 1), np.float32), np.arange(len(s))
        for low, high, a, b in bounds:
            d, total = self.shares(s[a:b], w["word"][low:high].T)
            d[nth[: b - a], y[a:b] - low] -= total
            part = np.divide(np.float32(-1), total[:, None], out=parts[a:b])
            np.matmul(d, w["word"][low:high, :HIDDEN], out=own[a:b])
            np.matmul(d.T, np.multiply(s[a:b], part, out=scaled[a:b]), out=grad["word"][low:high])
        own *= parts
        down += own
        back_of = (np.empty if whole else np.zeros)((steps * rows, HIDDEN), np.float32)
        back_of[ok] = down
        back_of = back_of.reshape(steps, rows, HIDDEN)
        back = np.zeros_like(h)
        all_dx, all_da = np.empty((2, steps, rows, 3 * HIDDEN), np.float32)
        back_state = np.ascontiguousarray(w["state"].T)
        for t in range(steps - 1, -1, -1):
            back = back + back_of[t]
            before, z, r, c, ac = kept[t]
            dx, da = all_dx[t], all_da[t]
            dc = back * z
            dz = dc * (c - before)
            dz *= 1 - z
            dc *= 1 - c * c
            dr = dc * ac
            dr *= r * (1 - r)
            dx[:, :HIDDEN], dx[:, HIDDEN : 2 * HIDDEN], dx[:, 2 * HIDDEN :] = dz, dr, dc
            da[:, : 2 * HIDDEN] = dx[:, : 2 * HIDDEN]
            np.multiply(dc, r, out=da[:, 2 * HIDDEN :])
            back = back * (1 - z) + da @ back_state
            if going is not None:
                back *= going[t]
        before = np.stack([k[0] for k in kept]).reshape(-1, HIDDEN)
        grad["state"] = before.T @ all_da.reshape(-1, 3 * HIDDEN)
        dx = all_dx.reshape(-1, 3 * HIDDEN)
        grad["gate"] = np.ones((1, len(dx)), np.float32) @ dx
        grad["in"] = embedded[at].T @ dx
        squares = memory["embed"][seen]
        # by symbol, in the narrower of the two spaces
        self.climb(embedded, squares, np.add.reduceat((dx @ w["in"].T)[by], first), weigh, rate)
        w["embed"][seen], memory["embed"][seen] = embedded, squares
        for k, g in grad.items():
            self.climb(w[k], memory[k], g, weigh, rate)
        return h

    @staticmethod
    def climb(w: np.ndarray, memory: np.ndarray, grad: np.ndarray, weigh: np.float32, rate: float) -> None:
        """Change weights (rows of a matrix) and their rows' running mean squares in place."""
        square = np.einsum("ij,ij->i", grad, grad) * (weigh * weigh / np.float32(grad.shape[1]))
        memory *= np.float32(0.95)
        memory += np.float32(0.05) * square
        grad *= (weigh * np.float32(rate) / (np.sqrt(memory) + np.float32(1e-3)))[:, None]
        w += grad


def _dealt(vocabulary: list[tuple[int, int]], rare: float) -> tuple[dict[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each word's place, in order of frequency, and the classes' bounds with the start biases.  -1 is the shared symbol."""
    counts = np.array([rare, *(n for _, n in vocabulary)], np.float64)
    order = np.argsort(-counts, kind="stable")
    place = np.empty(len(counts), np.int64)
    place[order] = np.arange(len(counts))
    counts = counts[order]
    root = np.cumsum(np.sqrt(counts / counts.sum()))
    width = root[-1] / max(1, round(root[-1]))
    of_class = np.floor((root - root[0]) / width).astype(np.int64)  # classes that no word falls into are left out
    of_class = np.cumsum(np.r_[0, np.diff(of_class) > 0])
    total = np.bincount(of_class, weights=counts)
    first = np.searchsorted(of_class, np.arange(len(total) + 1))
    return {w: int(p) for (w, _), p in zip(vocabulary, place[1:], strict=True)} | {-1: int(place[0])}, (first, np.log(total / total.sum()), np.log(counts / total[of_class]))


class Coder:
    """Symbols of token hashes."""

    def __init__(self, places: dict[int, int]):
        self.rare = places[-1]
        known = sorted((w, p) for w, p in places.items() if w != -1)
        self.words = np.array([w for w, _ in known], np.uint64)
        self.places = np.array([p for _, p in known], np.int64)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.words):
            return np.full(len(hashes), self.rare, np.int64)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.places[at], self.rare)


def _count(buckets: int):
    """A chunk's distinct words with their training counts for the buckets, and its texts as ordinals of these words (bucket -1)."""

    def count(table: pa.Table) -> pa.Table:
        ids, texts, nulls = in_order(table)
        chunk = table.column("chunk")[0].as_py()
        hashes, n = tokens(texts)
        learns = np.repeat(~held_out(ids, nulls), n)
        words, at = np.unique(hashes, return_inverse=True)
        counts = np.bincount(at, weights=learns, minlength=len(words)).astype(np.int64)
        bucket = np.searchsorted((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
        own = {"ids": packed(ids), "nulls": packed(nulls.astype(np.uint8)), "sizes": packed(n), "ordinals": packed(at.astype(np.uint32))}
        rows = [{"bucket": -1, "chunk": chunk, "n": len(hashes), "n_docs": len(ids), **own}]
        for b in np.flatnonzero(np.diff(bucket)).tolist():
            a, e = bucket[b], bucket[b + 1]
            rows.append({"bucket": b, "chunk": chunk, "n": int(e - a), "words": packed(words[a:e], True), "counts": packed(counts[a:e].astype(np.uint32))})
        return pa.Table.from_pylist(rows, schema=_schema(COUNTED))

    return count


def _sum(table: pa.Table) -> pa.Table:
    """A bucket: its words' totals for each chunk, and once for all (chunk -1)."""
    rows = table.to_pylist()
    words = [unpacked(r["words"], r["n"], np.uint64, True) for r in rows]
    counts = np.concatenate([unpacked(r["counts"], r["n"], np.uint32) for r in rows]).astype(np.int64)
    every, at = np.unique(np.concatenate(words), return_inverse=True)
    total = np.bincount(at, weights=counts, minlength=len(every)).astype(np.int64)
    at = np.split(at, np.cumsum([len(w) for w in words])[:-1])
    out = [{"chunk": r["chunk"], "n": r["n"], "words": packed(w, True), "counts": packed(total[i])} for r, w, i in zip(rows, words, at, strict=True)]
    out.append({"chunk": -1, "n": len(every), "words": packed(every, True), "counts": packed(total)})
    return pa.Table.from_pylist(out, schema=_schema(TOTALS))


def _summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of buckets' totals: number of words, their sum, and each bucket's most frequent words."""
    for batch in batches:
        for r in batch.to_pylist():
            words, counts = unpacked(r["words"], r["n"], np.uint64, True), unpacked(r["counts"], r["n"], np.int64)
            seen = counts > 0
            top = np.argsort(-counts, kind="stable")[:VOCABULARY]
            top = top[counts[top] > 0]
            yield pa.RecordBatch.from_pydict(
                {
                    "word": pa.array([0, *words[top].view(np.int64).tolist()], pa.int64()),
                    "n": pa.array([int(counts.sum()), *counts[top].tolist()], pa.int64()),
                    "distinct": pa.array([int(seen.sum()), *([0] * len(top))], pa.int64()),
                    "is_sum": pa.array([True, *([False] * len(top))]),
                }
            )


class Rows:
    """Rows of a batch, each with documents one after the other: the tokens that it is still to learn from."""

    def __init__(self, documents: Iterator[np.ndarray], start: int):
        self.documents, self.start = documents, start
        self.inputs: list[np.ndarray] = []
        self.targets: list[np.ndarray] = []
        self.fresh: list[np.ndarray] = []
        self.more = True

    def fill(self, rows: int, tokens: int) -> None:
        """Add rows up to ``rows`` and documents until each row has ``tokens`` tokens or no document is left."""
        while self.more and len(self.inputs) < rows:
            for held, kind in ((self.inputs, np.int64), (self.targets, np.int64), (self.fresh, bool)):
                held.append(np.empty(0, kind))
        for i in range(len(self.inputs)):
            size, added = len(self.inputs[i]), []
            while self.more and size < tokens:
                symbols = next(self.documents, None)
                if symbols is None:
                    self.more = False
                    break
                added.append(symbols)
                size += len(symbols)
            if added:
                first = np.zeros(sum(map(len, added)), bool)
                first[np.cumsum([0, *map(len, added[:-1])])] = True
                after = np.concatenate(added)
                before = np.concatenate([[self.start], after[:-1]])
                before[first] = self.start  # the token before a document's first is an end
                self.inputs[i] = np.concatenate([self.inputs[i], before])
                self.targets[i] = np.concatenate([self.targets[i], after])
                self.fresh[i] = np.concatenate([self.fresh[i], first])

    def take(self, tokens: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Up to ``tokens`` tokens of each row (inputs, targets, fresh, valid) and the rows' states; rows without any go."""
        h = np.concatenate([h, np.zeros((len(self.inputs) - len(h), h.shape[1]), np.float32)])
        left = [i for i, x in enumerate(self.inputs) if len(x)]
        h = h[left]
        self.inputs, self.targets, self.fresh = ([held[i] for i in left] for held in (self.inputs, self.targets, self.fresh))
        shape = (len(left), tokens)
        inputs, targets, fresh, valid = np.full(shape, self.start, np.int64), np.full(shape, self.start, np.int64), np.zeros(shape, bool), np.zeros(shape, bool)
        for i, x in enumerate(self.inputs):
            n = min(tokens, len(x))
            inputs[i, :n], targets[i, :n], fresh[i, :n], valid[i, :n] = x[:n], self.targets[i][:n], self.fresh[i][:n], True
            self.inputs[i], self.targets[i], self.fresh[i] = x[n:], self.targets[i][n:], self.fresh[i][n:]
        return inputs, targets, fresh, valid, h


def _documents(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of a coded chunk: ids, null flags, sizes, and the symbols of each text."""
    n = row["n_docs"]
    sizes = unpacked(row["sizes"], n, np.int64)
    return unpacked(row["ids"], n, np.int64), unpacked(row["nulls"], n, np.uint8) > 0, sizes, np.split(unpacked(row["symbols"], row["n"], np.uint16), np.cumsum(sizes)[:-1])


def _train_task(start: int, first: np.ndarray, weights: dict, rate: float):
    """Of coded chunks by shard: the sum of the shards' weights, each weighed by its tokens."""

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents(rows: Iterator[dict]) -> Iterator[np.ndarray]:
            for row in rows:
                ids, nulls, _, texts = _documents(row)
                for i in np.flatnonzero(~held_out(ids, nulls)).tolist():
                    yield texts[i]

        total, learnt = 0.0, 0
        rows = (batch.slice(k, 1).to_pylist()[0] for batch in batches for k in range(batch.num_rows))
        for _, mine in groupby(rows, key=itemgetter("shard")):
            model = Model(first[:2], np.zeros(1), np.zeros(1))
            model.w, model.first = {k: v.copy() for k, v in weights.items()}, first
            n = learn(model, documents(mine), start, rate)
            if n:
                total, learnt = total + n * np.concatenate([model.w[k].ravel() for k in sorted(model.w)]).astype(np.float64), learnt + n
        if learnt:
            yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "tokens": [learnt], "weights": [(total / learnt).astype("<f4").tobytes()]})

    return train


def learn(model: Model, documents: Iterator[np.ndarray], start: int, rate: float) -> int:
    """Train on every token of ``documents`` (symbols, an end last).  How many there were.

    The longest come first, so that the rows end at about the same time.
    """
    rows, memory, learnt, most = Rows(iter(sorted(documents, key=len, reverse=True)), start), {}, 0, 0
    h = np.zeros((0, HIDDEN), np.float32)
    while True:
        rows.fill(min(BATCH, max(FEWEST, learnt // TOKENS_A_ROW)), SPAN * WINDOW)
        inputs, targets, fresh, valid, h = rows.take(SPAN * WINDOW, h)
        if not len(h):
            return learnt
        most = max(most, len(h))
        # where few rows are left, windows are longer: a step costs the whole matrices, however few its tokens are
        window = WINDOW * min(SPAN, max(1, FEWEST // len(h)))
        for k in range(0, SPAN * WINDOW, window):
            at = slice(k, k + window)
            n = int(valid[:, at].sum())
            if not n:
                break
            # windows with few tokens are noisy, so their steps are shorter
            h = model.train(inputs[:, at], targets[:, at], valid[:, at], h, memory, rate * min(1.0, n / (most * WINDOW)) ** 0.5, fresh[:, at])
            learnt += n


def _average(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = 0.0, 0
    for batch in parts:
        for r in batch.to_pylist():
            total, n = total + np.frombuffer(r["weights"], "<f4").astype(np.float64) * r["tokens"], n + r["tokens"]
    yield pa.RecordBatch.from_pydict({"part": pa.array([key[0].as_py()], pa.int32()), "tokens": [n], "weights": [(total / n).astype("<f4").tobytes()]})


def train_model(coded: DataFrame, n_train: int, start: int, classes: tuple[np.ndarray, np.ndarray, np.ndarray], rounds: int = ROUNDS) -> Model:
    """Copies of the weights learn from shards of the coded chunks and are averaged.

    What a shard learns doesn't depend on where it runs.  A task sends the average of its shards; these meet ``FAN`` at a time, in
    as many levels as it takes until the driver gets at most ``FAN`` copies.
    """
    model = Model(*classes)
    names = sorted(model.w)
    shards = max(1, -(-n_train // SHARD_TOKENS))
    dealt = coded.withColumn("shard", F.pmod(F.col("chunk"), F.lit(shards))).repartition("shard").sortWithinPartitions("shard", "chunk")
    for k in range(rounds):
        parts = dealt.mapInArrow(_train_task(start, model.first, model.w, RATE / (1 + k)), "part int, tokens long, weights binary")
        most = int(coded.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        while most > FAN:
            parts = parts.withColumn("part", (F.col("part") / FAN).cast("int")).groupBy("part").applyInArrow(_average, "part int, tokens long, weights binary")
            most = -(-most // FAN)
        rows = sorted(parts.collect(), key=itemgetter("part"))  # at most FAN copies
        if not rows:
            break
        n = sum(r["tokens"] for r in rows)
        flat = sum(np.frombuffer(r["weights"], "<f4").astype(np.float64) * (r["tokens"] / n) for r in rows)
        at = 0
        for name in names:
            model.w[name] = flat[at : at + model.w[name].size].reshape(model.w[name].shape).astype(np.float32)
            at += model.w[name].size
    return model


def score_chunk(model: Model, symbols: np.ndarray, n: np.ndarray, start: int) -> np.ndarray:
    """log10 probability of every text's symbols: all texts take their steps together, the longest first."""
    first = np.cumsum(n) - n
    out = np.zeros(len(n))
    order = np.argsort(-n, kind="stable")
    length = n[order]
    projected = model.w["embed"] @ model.w["in"] + model.w["gate"]
    h = np.zeros((len(n), HIDDEN), np.float32)
    symbol = np.full(len(n), start, np.int64)
    total = np.zeros(len(n))
    held: list[tuple[np.ndarray, np.ndarray, int]] = []
    pending = 0

    def settle() -> None:
        nonlocal pending
        if held:
            states, targets = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            log = model.log_probs(states, targets)
            at = 0
            for s, _, m in held:
                total[:m] += log[at : at + m]
                at += m
            held.clear()
            pending = 0

    for t in range(int(length[0]) if len(n) else 0):
        m = int(np.searchsorted(-length, -t, side="left"))  # texts with more than t tokens
        h = model.step(model.w, projected[symbol[:m]], h[:m])
        symbol = symbols[first[order[:m]] + t]
        held.append((h, symbol, m))
        pending += m
        if pending >= 1 << 15:
            settle()
    settle()
    out[order] += total
    return out / np.log(10)


def _code(coder: Coder, n_train: int, distinct: int, rare_mass: float):
    """A chunk's texts as the model's symbols, with what follows from counts alone."""

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_pylist([], schema=_schema(CODED))
        row, sent = left.to_pylist()[0], right.to_pylist()
        words = np.concatenate([np.empty(0, np.uint64), *(unpacked(r["words"], r["n"], np.uint64, True) for r in sent)])
        counts = np.concatenate([np.empty(0, np.int64), *(unpacked(r["counts"], r["n"], np.int64) for r in sent)])
        order = np.argsort(words)  # the ordinals are places among the chunk's words in order
        words, c = words[order], counts[order]
        symbols = coder(words)
        # words that share the model's symbol: by their counts among such words
        rare_log = np.where(symbols == coder.rare, np.log10((c + 0.5) / rare_mass), 0.0)
        base_log = np.log10((c + 0.5) / (n_train + 0.5 * (distinct + 1)))
        at, sizes = unpacked(row["ordinals"], row["n"], np.uint32), unpacked(row["sizes"], row["n_docs"], np.int64)
        first = np.cumsum(sizes) - sizes
        of_text = {"known": np.add.reduceat((c > 0).astype(np.int64)[at], first), "base": np.add.reduceat(base_log[at], first), "extra": np.add.reduceat(rare_log[at], first)}
        out = {k: row[k] for k in ("chunk", "n", "n_docs", "ids", "nulls", "sizes")} | {k: packed(v) for k, v in of_text.items()}
        return pa.Table.from_pylist([out | {"symbols": packed(symbols.astype(np.uint16)[at])}], schema=_schema(CODED))

    return code


def _score(model: Model, start: int, n_train: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, nulls, n, _ = _documents(row)
                known, base, extra = (unpacked(row[x], row["n_docs"], kind) for x, kind in (("known", np.int64), ("base", np.float64), ("extra", np.float64)))
                out = extra + score_chunk(model, unpacked(row["symbols"], row["n"], np.uint16).astype(np.int64), n, start)
                columns = [pa.array(ids, mask=nulls), held_out(ids, nulls), n, known, np.full(len(n), n_train), base, out]
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(columns, _schema(SCORED), strict=True)], schema=_schema(SCORED))

    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    size = text_bytes(docs, text_col)
    counted = chunked(docs, id_col, text_col, size).groupBy("chunk").applyInArrow(_count(pieces_for(size, BUCKET_BYTES, least=64)), COUNTED)
    counted = spill(counted, "word-counts")
    totals = spill(counted.where("bucket >= 0").select("bucket", "chunk", "n", "words", "counts").groupBy("bucket").applyInArrow(_sum, TOTALS), "word-totals")
    summary = totals.where("chunk = -1").mapInArrow(_summary, "word long, n long, distinct long, is_sum boolean")
    summary = spill(summary, "word-summary")
    sums = summary.where("is_sum").agg(F.sum("n").alias("n"), F.sum("distinct").alias("distinct")).first()
    n_train, distinct = sums["n"] or 0, sums["distinct"] or 0
    top = summary.where("not is_sum and n > 1").orderBy(F.desc("n"), "word").limit(VOCABULARY - 1).collect()  # at most VOCABULARY rows
    vocabulary = [(r["word"] % 2**64, r["n"]) for r in top]
    rare = n_train - sum(n for _, n in vocabulary)
    # the shared symbol's words, seen or not, smoothed as in the base score
    rare_mass = rare + 0.5 * (distinct - len(vocabulary) + 1)
    places, classes = _dealt(vocabulary, rare_mass)
    coder = Coder(places)
    start = int(coder(np.array([END], np.uint64))[0])
    texts = counted.where("bucket = -1").select("chunk", "n", "n_docs", "ids", "nulls", "sizes", "ordinals")
    coded = texts.groupBy("chunk").cogroup(totals.where("chunk >= 0").groupBy("chunk")).applyInArrow(_code(coder, n_train, distinct, rare_mass), CODED)
    coded = spill(coded, "coded")
    model = train_model(coded.select("chunk", "n", "n_docs", "ids", "nulls", "sizes", "symbols"), n_train, start, classes, rounds)
    return coded.mapInArrow(_score(model, start, n_train), SCORED)
