"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts come from every labelled training row, summed by Spark; the
log-probability matrix (languages x buckets) is broadcast, and texts are scored in
batches with numpy.  Log probabilities are rounded to integers first, so sums do not
depend on how rows are batched.

Null or letterless text: `und`, score 0.  No training rows: `und` for all rows.
Repeated rows each get a row.  Ties go to the smallest language name.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import counting
from .shared import only, tune
from .tokens import flat, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDERS = (1, 2, 3)
BUCKETS = 1 << 16
SCALE = 1 << 12
#: The matrix of so many languages has 256 MB, which is what the broadcast may hold; more raise.
MOST_LANGUAGES = 1024
_MUL = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
_letters: dict = {}


def _is_letter(cp: np.ndarray) -> np.ndarray:
    if "table" not in _letters:
        _letters["table"], _letters["known"] = np.zeros(0x110000, bool), np.zeros(0x110000, bool)
    table, known = _letters["table"], _letters["known"]
    for c in np.unique(cp[~known[cp]]):
        table[c], known[c] = chr(c).isalpha(), True
    return table[cp]


def features(col: pa.Array):
    """Bucket arrays (one per order) with the row of each n-gram; the number of letters per row.

    Characters other than letters become one space between words; n-grams never cross rows."""
    buf, offs = flat(col)
    cp = np.frombuffer(buf.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs]  # row offsets in code points
    letter = _is_letter(cp)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(at))
    n_letters = np.bincount(row, weights=letter, minlength=len(offs) - 1).astype(np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1] & (row[1:] == row[:-1])  # the first other character after a letter
    cp = np.where(letter, cp, 32).astype(np.uint32)[keep]
    row = row[keep]
    out = []
    for n in ORDERS:
        m = max(0, len(cp) - n + 1)
        h = np.full(m, 97 * n, np.uint32)
        for j in range(n):
            h ^= cp[j : j + m]
            h *= _MUL[j]
            h ^= h >> np.uint32(15)
        same = row[:m] == row[n - 1 : n - 1 + m]
        out.append(((h[same] & np.uint32(BUCKETS - 1)).astype(np.int64), row[:m][same]))
    return out, n_letters


def _count(it):
    totals: dict = {}
    for batch in it:
        for part in pieces(batch, "text"):
            names, inverse = np.unique(np.array(part.column("lang").to_pylist(), object).astype(str), return_inverse=True)
            grams, _ = features(part.column("text"))
            for k, name in enumerate(names):
                t = totals.setdefault(name, np.zeros(2 * BUCKETS, np.int64))
                t[BUCKETS] += int((inverse == k).sum())  # documents
                for b, row in grams:
                    t[:BUCKETS] += np.bincount(b[inverse[row] == k], minlength=BUCKETS)
    yield counting.emit(totals)


def fit(train: DataFrame) -> tuple[list, np.ndarray, np.ndarray]:
    """Languages, integer log-probability matrix and priors, from all rows of (text, lang)."""
    rows = train.where("lang is not null and text is not null").select(F.lower("text").alias("text"), "lang")
    if train.where("lang is not null").select("lang").distinct().count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    sums = counting.collect(rows.mapInArrow(_count, counting.SCHEMA), 2 * BUCKETS)
    names = sorted(sums)
    if not names:
        return [], np.zeros((0, BUCKETS), np.int32), np.zeros(0, np.int64)
    grams = np.array([sums[n][:BUCKETS] for n in names], float) + 0.5
    docs = np.array([sums[n][BUCKETS] for n in names], float)
    logp = np.log(grams / grams.sum(1, keepdims=True))
    return names, np.rint(logp * SCALE).astype(np.int32), np.rint(np.log(docs / docs.sum()) * SCALE).astype(np.int64)


def predict(docs: DataFrame, model, keep: list[str]) -> DataFrame:
    """lang_pred and score for every row, with the columns `keep`; reads nothing but the text."""
    names, matrix, prior = model
    shared = docs.sparkSession.sparkContext.broadcast(matrix)
    base = docs.select(*keep, F.lower("text").alias("text"))
    schema = base.drop("text").schema.add("lang_pred", "string").add("score", "double")

    def score(it):
        logp = shared.value
        for batch in it:
            for part in pieces(batch, "text"):
                grams, letters = features(part.column("text"))
                total = np.tile(prior, (part.num_rows, 1))
                for b, row in grams:
                    first = np.flatnonzero(np.diff(row, prepend=-1))
                    if len(first):
                        for k in range(len(names)):
                            total[row[first], k] += np.add.reduceat(logp[k][b], first, dtype=np.int64)
                pred, sure = np.full(part.num_rows, "und", object), np.zeros(part.num_rows)
                if len(names):
                    best = total.argmax(1)
                    sure = 1 / np.exp((total - total.max(1, keepdims=True)) / SCALE).sum(1)
                    pred = np.array(names, object)[best]
                pred[letters == 0], sure[letters == 0] = "und", 0.0
                cols = [part.column(c) for c in keep] + [pa.array(pred, pa.string()), pa.array(sure)]
                yield pa.record_batch(cols, names=[*keep, "lang_pred", "score"])

    return base.mapInArrow(score, schema)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 3 == 1


def identify(docs: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict all rows."""
    tune(docs.sparkSession)
    docs = only(docs, "doc_id", "text", "lang").withColumn("held_out", held_out())
    return predict(docs, fit(docs.where("not held_out")), ["doc_id", "held_out"])
