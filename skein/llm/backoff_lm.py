"""Stupid-backoff scores of every document against the counts of all other documents.

Documents are dealt to batches by hash.  Each batch sends its distinct n-grams (all orders up
to `order`, 56-bit hashes) with counts to the count table's partitions, dealt by n-gram hash and
packed in sorted arrays; each partition sums its n-grams over all batches and answers every
batch with the totals of the n-grams that it asked for.  The batch then scores its documents:
a document's own counts are taken off, so it is scored by the rest of the corpus.

Score of a word: count(n-gram) / count(context) at the longest order whose n-gram the other
documents have, times `ALPHA` for each order left out; for a word that they don't have,
1 / (number of their words), with the same factors.  The sum of natural logarithms is the
document's score.

Words are `[^\\x20\\x09-\\x0D]+`.  Null or empty text: 0 words, score 0, mean null.  Every row is
a document of its own, also when rows repeat an id or text.  A corpus of one document has no
other words; their number counts as 1.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, tune
from .tokens import Words, grams, mix, pack, pack_sorted, unpack, unpack_sorted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
ORDER = 3
ALPHA = 0.4
BATCH_BYTES = 8 << 20
ASKED = "bucket int, batch long, n int, keys binary, counts binary"
TOLD = "batch long, bucket int, n int, totals binary"
SCORES = "doc_id long, n_words long, log_score double, mean_log double, n_hits long, n_unseen long"


def keys_of(col: pa.Array, order: int):
    """Words, and for each order the keys of all n-grams with their first words."""
    w = Words(col)
    h = w.hashes()
    out = []
    for n in range(1, order + 1):
        g, at = grams(h, w.row, n)
        out.append((mix(g + _U(n)) >> _U(8), at))
    return w, out


def _ask(order: int, buckets: int):
    def run(table: pa.Table) -> pa.Table:
        _, keys = keys_of(table.column("text"), order)
        u, c = np.unique(np.concatenate([k for k, _ in keys]), return_counts=True)
        b = ((u >> _U(24)) * _U(buckets) >> _U(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(b, prepend=-1, append=buckets)) if len(b) else np.zeros(1, np.int64)
        batch = table.column("batch")[0].as_py()
        rows = [(int(b[x]), batch, int(y - x), pack_sorted(u[x:y]), pack(c[x:y])) for x, y in zip(cuts[:-1], cuts[1:])]
        return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "batch", "n", "keys", "counts"])

    return run


def _tell(table: pa.Table) -> pa.Table:
    """One partition of the count table, and its answer to each batch."""
    batch, bucket, n, keys, counts = (table.column(c).to_pylist() for c in ("batch", "bucket", "n", "keys", "counts"))
    k = np.concatenate([unpack_sorted(x, y) for x, y in zip(keys, n)])
    c = np.concatenate([unpack(x, y) for x, y in zip(counts, n)])
    order = np.argsort(k, kind="stable")
    new = np.concatenate([[True], k[order][1:] != k[order][:-1]])
    total = np.add.reduceat(c[order], np.flatnonzero(new))
    out = np.empty(len(k), np.uint64)
    out[order] = total[np.cumsum(new) - 1]
    at = np.concatenate([[0], np.cumsum(n)])
    blobs = [pack(out[x:y]) for x, y in zip(at[:-1], at[1:])]
    return pa.table([pa.array(batch, pa.int64()), pa.array(bucket, pa.int32()), pa.array(n, pa.int32()), pa.array(blobs, pa.binary())], names=["batch", "bucket", "n", "totals"])


def _others(w: Words, keys, totals: np.ndarray):
    """Count of each n-gram occurrence in the other documents, by first word; for each order."""
    every = np.concatenate([k for k, _ in keys])
    order = np.argsort(every, kind="stable")
    new = np.concatenate([[True], every[order][1:] != every[order][:-1]]) if len(every) else np.zeros(0, bool)
    slot = np.empty(len(every), np.int64)
    slot[order] = np.cumsum(new) - 1
    out, at = [], 0
    for k, first in keys:
        s = slot[at : at + len(k)]
        at += len(k)
        rest = np.zeros(len(w.start), np.int64)
        edges = np.flatnonzero(np.diff(w.row[first], prepend=-1, append=-2)) if len(first) else np.zeros(1, np.int64)
        for x, y in zip(edges[:-1], edges[1:]):
            u, inv, c = np.unique(s[x:y], return_inverse=True, return_counts=True)
            rest[first[x:y]] = (totals[u] - c)[inv]
        out.append(rest)
    return out


def scores(w: Words, rest: list, words: int, alpha: float = ALPHA):
    """Log score of each word and the order at which it was found (0: unseen)."""
    n_doc = w.counts()
    left = np.maximum(1, words - n_doc)[w.row] if len(w.row) else np.zeros(0)
    logs, found = np.zeros(len(w.start)), np.zeros(len(w.start), np.int64)
    place = np.arange(len(w.start)) - w.first[w.row] if len(w.row) else np.zeros(0, np.int64)
    for i in range(len(rest), 0, -1):
        ok = np.flatnonzero((found == 0) & (place >= i - 1))
        c = rest[i - 1][ok - (i - 1)]
        ok, c = ok[c > 0], c[c > 0]
        under = rest[i - 2][ok - (i - 1)] if i > 1 else left[ok]
        skipped = np.minimum(len(rest) - 1, place[ok]) - (i - 1)
        logs[ok] = np.log(c / under) + skipped * np.log(alpha)
        found[ok] = i
    ok = np.flatnonzero(found == 0)
    logs[ok] = -np.log(left[ok]) + np.minimum(len(rest) - 1, place[ok]) * np.log(alpha)
    return logs, found


def _score(order: int, words: int):
    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        w, keys = keys_of(docs.column("text"), order)
        answers = sorted(zip(*(told.column(c).to_pylist() for c in ("bucket", "n", "totals"))), key=lambda x: x[0])
        totals = np.concatenate([unpack(t, n) for _, n, t in answers] or [np.zeros(0, np.uint64)]).view(np.int64)
        logs, found = scores(w, _others(w, keys, totals), words)
        n = w.counts()
        per = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[w.first])
        total = np.array([logs[a:b].sum() for a, b in zip(w.first[:-1], w.first[1:])], float)  # row by row: the same sum however rows are batched
        mean = pa.array(np.where(n > 0, total / np.maximum(n, 1), 0.0), mask=n == 0)
        return pa.table([docs.column("doc_id").cast(pa.int64()), pa.array(n, pa.int64()), pa.array(total), mean, pa.array(per(found == order), pa.int64()), pa.array(per(found == 0), pa.int64())], names=["doc_id", "n_words", "log_score", "mean_log", "n_hits", "n_unseen"])

    return run


def score(docs: DataFrame, order: int = ORDER, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """doc_id, n_words, log_score, mean_log, n_hits (words found at the full order) and n_unseen of every row."""
    tune(docs.sparkSession)
    d = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    size, words = d.agg(F.sum(F.octet_length("text")), F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()
    batches = max(12, (size or 0) // batch_bytes)
    d = d.withColumn("batch", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(batches)))
    asked = d.groupBy("batch").applyInArrow(_ask(order, max(12, (size or 0) // (16 << 20))), ASKED)
    told = asked.groupBy("bucket").applyInArrow(_tell, TOLD)
    return d.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(_score(order, words or 0), SCORES)
