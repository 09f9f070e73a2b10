"""Quality rules: fixed counts per document, and a hashed n-gram log-likelihood ratio.

The ratio compares a trusted-target multinomial (labelled good documents) with the
raw-corpus multinomial over hashed byte n-grams, divided by the number of n-grams.  Raw
counts cover every document, the target every good one, and the threshold is fitted on
every labelled one; every document is then held against the same threshold.

Labels reach the texts as sorted ids and flags, sent to each task, if they are at most `few`
and ids are whole numbers; else both tables are dealt by id.  The result is the same.

Null or empty text: all counts 0, base_failed true, kept false.  Without labelled rows of
both kinds, the ratio rejects nothing.  Repeated rows each get a row.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, IntegerType, LongType, ShortType

from . import counting
from .shared import Scratch, only, tune
from .tokens import SPACED, Words, _BYTE, _power, flat, grams, mix, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
SCALE = 1 << 12
#: Up to so many labels are sent to each task, at 9 bytes each.
FEW = 1 << 23
#: Characters of `[#*$%&|<>]`.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for every key that stands twice or more."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    flag = np.zeros(len(keys), bool)
    flag[order[1:][same]] = True
    flag[order[:-1][same]] = True
    return flag


def _line_hashes(w: Words):
    """Row and hash of every line that holds a word, as one key."""
    p, inv = _power(len(w.buf))
    s = np.zeros(len(w.buf) + 1, np.uint64)
    np.cumsum(_BYTE[w.buf] * p[: len(w.buf)], dtype=np.uint64, out=s[1:])
    nl = np.flatnonzero(w.buf == 10)
    begin = np.unique(np.concatenate([w.offs[:-1], nl + 1]))
    at = begin[np.unique(np.searchsorted(begin, w.start, "right") - 1)]  # lines with a word
    k = np.searchsorted(nl, at, "left")
    row = np.searchsorted(w.offs, at, "right") - 1
    end = np.minimum(np.append(nl, len(w.buf))[k], w.offs[row + 1])
    return row, mix((s[end] - s[at]) * inv[at] + (end - at).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + row.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))


def base_counts(col: pa.Array) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each row."""
    w = Words(col)
    n = len(w.offs) - 1
    per_row = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[w.offs])
    out = {"n_words": w.counts(), "word_chars": per_row(SPACED[w.buf] & ((w.buf & 0xC0) != 0x80)), "n_symbols": per_row(SYMBOLS[w.buf])}
    row, key = _line_hashes(w)
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=n) - np.bincount(row[first], minlength=n)
    g, at = grams(w.hashes(), w.row, 3)
    hit = at[repeated(mix(g + w.row[at].astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)))]
    covered = np.zeros(len(w.row) + 3, bool)
    for j in range(3):
        covered[hit + j] = True
    out["n_repeat_words"] = np.bincount(w.row[covered[: len(w.row)]], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _hashed(col: pa.Array):
    """Buckets of the byte n-grams of each order, with the row of each."""
    buf, offs = flat(col)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    b = buf.astype(np.uint32)
    for n in ORDERS:
        m = max(0, len(b) - n + 1)
        v = np.full(m, n, np.uint32)
        for j in range(n):
            v = (v << np.uint32(8)) | b[j : j + m]
        v *= np.uint32(2654435761)
        same = row[:m] == row[n - 1 : n - 1 + m]
        yield (v >> np.uint32(16))[same].astype(np.int64), row[:m][same]


def _known(shared):
    """Text and label of the rows that have one."""

    def run(it):
        ids, good = shared.value
        for batch in it:
            col = batch.column("doc_id").cast(pa.int64())
            own = np.array(col.fill_null(0)).astype(np.int64)
            at = np.minimum(np.searchsorted(ids, own), max(0, len(ids) - 1))
            there = (ids[at] == own) & np.array(col.is_valid()) if len(ids) else np.zeros(len(own), bool)
            yield pa.record_batch([batch.column("text"), pa.array(good[at] if len(ids) else there)], names=["text", "good"]).filter(pa.array(there))

    return run


def _count(key: str, label=iter):
    """Counts of the buckets over all texts, or over those with a good label."""

    def run(it):
        seen = np.zeros(BUCKETS, np.int64)
        for batch in label(it):
            batch = batch.filter(batch.column("good")) if key == "good" else batch
            for part in pieces(batch, "text"):
                for b, _ in _hashed(part.column("text")):
                    seen += np.bincount(b, minlength=BUCKETS)
        yield counting.emit({key: seen})

    return run


def ratio_of(col: pa.Array, weights: np.ndarray) -> np.ndarray:
    """Length-normalised ratio of each row, in units of 1/SCALE; 0 for an empty text."""
    n = len(col)
    total, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for b, row in _hashed(col):
        first = np.flatnonzero(np.diff(row, prepend=-1))
        if len(first):
            total[row[first]] += np.add.reduceat(weights[b], first, dtype=np.int64)
            size += np.bincount(row, minlength=n)
    return total / np.maximum(size, 1)


def _ratios(weights, label):
    def run(it):
        w = weights.value
        for batch in label(it):
            for part in pieces(batch, "text"):
                yield pa.record_batch([part.column("good"), pa.array(np.floor(ratio_of(part.column("text"), w)).astype(np.int64))], names=["good", "bin"])

    return run


def threshold(bins: list) -> float:
    """The cut between (bin, good, n) counts that errs least, a wrongly rejected good document counting five times; the middle of the best gap."""
    if not {g for _, g, _ in bins} >= {True, False}:
        return float("-inf")
    count: dict = {}
    for b, g, n in bins:
        count.setdefault(b, [0, 0])[int(g)] += n
    bad_left = sum(c[0] for c in count.values())
    lost, best, at, last = 0, bad_left, None, None
    spots = sorted(count)
    for i, b in enumerate(spots):
        bad_left -= count[b][0]
        lost += 5 * count[b][1]
        if bad_left + lost < best:
            best, at, last = bad_left + lost, b, spots[i + 1] if i + 1 < len(spots) else b + 1
    return float("-inf") if at is None else (at + 1 + last) / 2


def fit(docs: DataFrame, labels: DataFrame, few: int = FEW):
    """Integer weights per bucket and the threshold, in units of 1/SCALE, from all texts and all labels."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    known = only(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
    known = known.groupBy("doc_id").agg((F.min("quality") >= 1).alias("good"))
    docs = docs.where("text is not null")
    whole = all(isinstance(x.schema["doc_id"].dataType, (ByteType, ShortType, IntegerType, LongType)) for x in (docs, known))
    if whole and known.count() <= few:
        t = known.toArrow()  # at most `few` rows
        ids, good = np.array(t["doc_id"]).astype(np.int64), np.array(t["good"]).astype(bool)
        order = np.argsort(ids)
        labelled, label = docs, _known(spark.sparkContext.broadcast((ids[order], good[order])))
    else:
        labelled, label = scratch.cut(docs.join(known, "doc_id").select("text", "good")), iter
    sums = counting.collect(docs.select("text").mapInArrow(_count("raw"), counting.SCHEMA), BUCKETS)
    sums |= counting.collect(labelled.mapInArrow(_count("good", label), counting.SCHEMA), BUCKETS)
    raw, good = (sums.get(k, np.zeros(BUCKETS, np.int64)) + 0.5 for k in ("raw", "good"))
    weights = np.rint((np.log(good / good.sum()) - np.log(raw / raw.sum())) * SCALE).astype(np.int32)
    if "good" not in sums:
        weights[:] = 0
    shared = spark.sparkContext.broadcast(weights)
    bins = labelled.mapInArrow(_ratios(shared, label), "good boolean, bin long").groupBy("bin", "good").count()
    cut = threshold([(r["bin"], r["good"], r["count"]) for r in bins.collect()])  # as many rows as the ratio has values
    scratch.close()
    return shared, cut


def judge(docs: DataFrame, labels: DataFrame, few: int = FEW, also: tuple = ()) -> DataFrame:
    """The counts, score, base_failed and kept of every row, with the columns `also` beside doc_id."""
    tune(docs.sparkSession)
    shared, cut = fit(only(docs, "doc_id", "text"), labels, few)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    base = only(docs, *dict.fromkeys(["doc_id", "text", *also]))
    carried = [c for c in base.columns if c != "text" or "text" in also]
    schema = base.select(*carried).schema
    for c in names:
        schema = schema.add(c, "long")
    schema = schema.add("score", "double").add("base_failed", "boolean").add("kept", "boolean")

    def run(it):
        w = shared.value
        for batch in it:
            for part in pieces(batch, "text"):
                c = base_counts(part.column("text"))
                ratio = ratio_of(part.column("text"), w)
                failed = (c["n_words"] < 50) | (100 * c["n_repeat_words"] > 50 * c["n_words"])
                cols = [part.column(x) for x in carried] + [pa.array(c[x]) for x in names]
                cols += [pa.array(ratio / SCALE), pa.array(failed), pa.array(~failed & (ratio >= cut))]
                yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return base.mapInArrow(run, schema)
