"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of 1 to 3 characters of whole training texts by language, in a fixed
number of hash buckets, so the counts (at most ``MOST_CELLS``) have a proven size whatever the
corpus; partial counts of a task are summed in Spark, and the log-probability matrix is broadcast.
Scoring adds the matrix rows of all n-grams of a text, in numpy batches.

Texts are lower-cased; white space and other characters that aren't letters become one space.
Training takes a sample of the labelled rows if there are more than ``max_train`` of them (rows with
the smallest hashes of their ids); everything is predicted.

``und`` with score 0 is returned if the text is null or has no letter, or no row has a label.
Equal scores: the first language in sorted order.  Null ids are never held out.  Repeated ids
give a row each.  Long texts count whole, a chunk of characters at a time.  An empty table gives an empty result.  Other columns are
kept as they are, but for those named lang_pred and score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import in_small_batches

BUCKETS = 1 << 16
MAX_TRAIN = 200_000
ORDERS = (1, 2, 3)
SMOOTHING = 0.5
#: n-grams of one text aren't independent: its mean log-probability counts as so many n-grams.
EVIDENCE = 60.0
CHUNK_CHARS = 1 << 20
UNKNOWN = "und"
#: Numbers of the log-probability matrix, at most (64 MB).
MOST_CELLS = 1 << 24
#: A column name that no table has.
FOUND = "language guess of tidewatch"


def _fold_table() -> np.ndarray:
    """Lower-case letter of every code point of the basic plane; other characters give a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if not 0xD800 <= c < 0xE000 and (x := chr(c)).isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


_fold: list[np.ndarray] = []


def _folded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Folded characters of all texts, a space around each, runs of spaces made one; owner of each; letters of each text."""
    if not _fold:
        _fold.append(_fold_table())
    data = np.frombuffer(("\n" + "\n".join([*texts, ""])).encode("utf-32-le", "replace"), np.uint32)
    owner = np.zeros(len(data), np.int32)
    owner[np.cumsum([0, *(len(t) + 1 for t in texts)])[:-1]] = 1
    owner = np.cumsum(owner, dtype=np.int32) - 1
    low = _fold[0][np.minimum(data, (1 << 16) - 1)]
    for c in np.unique(data[data >= 1 << 16]).tolist():  # beyond the basic plane
        low[data == c] = c if chr(c).isalpha() else 32
    keep = np.ones(len(low), bool)
    keep[1:] = (low[1:] != 32) | (low[:-1] != 32) | (owner[1:] != owner[:-1])
    low, owner = low[keep], owner[keep]
    letters = np.bincount(owner[low != 32], minlength=len(texts))
    return low, owner, letters


def _grams(low: np.ndarray, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """Hash buckets of the n-grams at each place, for each order."""
    value = low.astype(np.uint32) + np.uint32(1)
    running = value.copy()
    for n in range(1, max(ORDERS) + 1):
        if n > 1:
            running = running[:-1] * np.uint32(0x01000193) + value[n - 1 :]
        if n in ORDERS and len(running):
            h = (running ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
            yield (h * np.uint32(0xC2B2AE35) >> np.uint32(32 - int(buckets).bit_length() + 1)).astype(np.int32), n


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK_CHARS`` characters."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK_CHARS:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def train(labelled: DataFrame, text_col: str, lang_col: str, buckets: int = BUCKETS) -> tuple[list[str], np.ndarray]:
    """The languages in order and their log-probabilities, (buckets, languages), float32."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            by_lang: dict[str, list[str]] = {}
            for t, lang in zip(texts, langs, strict=True):
                by_lang.setdefault(lang, []).append(t)
            for lang, mine in by_lang.items():
                total, n = held.setdefault(lang, [np.zeros(buckets, np.int64), np.zeros(1, np.int64)])
                n += len(mine)
                for a, b in _chunks(mine):
                    low, _, _ = _folded(mine[a:b])
                    for h, _ in _grams(low, buckets):
                        total += np.bincount(h, minlength=buckets)
        for lang, (total, n) in held.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": [lang] * (len(at) + 1), "bucket": [-1, *at.tolist()], "n": [int(n[0]), *total[at].tolist()]})

    counts = labelled.select(text_col, lang_col).mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = counts.toArrow()  # at most (buckets + 1) x languages
    langs = sorted(set(rows.column("lang").to_pylist()))
    table, docs = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    lang = np.array([langs.index(x) for x in rows.column("lang").to_pylist()], np.int64)
    bucket, n = rows.column("bucket").to_numpy(), rows.column("n").to_numpy()
    real = bucket >= 0
    table[bucket[real], lang[real]] = n[real]
    docs[lang[~real]] = n[~real]
    # classes weigh the same: what the training rows happen to hold says little of a text
    return langs, np.log((table + SMOOTHING) / (table.sum(0) + SMOOTHING * buckets)).astype(np.float32)


def score_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray) -> tuple[list[str], list[float]]:
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    if not langs:
        return names, scores
    full = [t or "" for t in texts]
    for a, b in _chunks(full):
        low, owner, letters = _folded(full[a:b])
        total, count = np.zeros((b - a, len(langs))), np.zeros(b - a)
        for h, n in _grams(low, len(matrix)):
            mine, last = owner[: len(h)], owner[n - 1 :]
            inside = mine == last
            firsts = np.flatnonzero(np.r_[True, mine[1:] != mine[:-1]])
            values = matrix[h]
            values[~inside] = 0
            total[mine[firsts]] += np.add.reduceat(values, firsts, axis=0, dtype=np.float64)
            count += np.bincount(mine[inside], minlength=b - a)
        mean = total / np.maximum(count, 1)[:, None]
        odds = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(count, EVIDENCE)[:, None])
        share = odds / odds.sum(1, keepdims=True)
        best = mean.argmax(1)
        for i in np.flatnonzero(letters):
            names[a + i], scores[a + i] = langs[best[i]], float(share[i, best[i]])
    return names, scores


def held_out_of(id_col: str, parts: int, rest: int) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(parts)) == rest, F.lit(False))


def guesses(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN) -> Column:
    """A column of ``docs``: struct of lang_pred and score.

    Learns, at once, from the rows where ``training`` holds and ``lang_col`` isn't null.  Only texts go to Python and only the answers
    come back; Spark keeps the other columns meanwhile.
    """
    spark = in_small_batches(docs).sparkSession
    labelled = docs.where(training & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    n, n_langs = labelled.agg(F.count(F.lit(1)), F.count_distinct("lang")).first()
    if n > max_train:  # a bounded sample, the same in every run
        labelled = labelled.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * max_train / n))
    # what is broadcast has at most MOST_CELLS numbers: many languages share fewer buckets
    buckets = min(BUCKETS, 1 << max(8, (MOST_CELLS // max(1, n_langs)).bit_length() - 1))
    langs, matrix = train(labelled, "text", "lang", buckets)
    model = spark.sparkContext.broadcast((langs, matrix))

    @F.arrow_udf("lang_pred string, score double")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = score_texts(texts.to_pylist(), *model.value)
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang_pred", "score"])

    # not to be computed again where a filter on it is pushed down
    return predict.asNondeterministic()(F.col(text_col).cast("string"))


def identify(docs: DataFrame, training: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", max_train: int = MAX_TRAIN, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, all by default) with lang_pred and score, which take the place of columns of these names."""
    found = guesses(docs, training, id_col, text_col, lang_col, max_train)
    columns = [F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score")]
    return docs.select(*columns, found.alias(FOUND)).select(*columns, F.col(f"`{FOUND}`.lang_pred"), F.col(f"`{FOUND}`.score"))


def language_digest(docs: DataFrame) -> DataFrame:
    held = held_out_of("doc_id", 4, 2)
    out = identify(docs.select("doc_id", "text", "lang"), ~held, keep=["doc_id"])
    return out.select("doc_id", held_out_of("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")
