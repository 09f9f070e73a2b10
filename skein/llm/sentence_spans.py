"""Substring dedup by sliding sentence spans.

Sentences end at a line break or at `.`, `!` or `?` before white space.  For every sentence,
the shortest run of consecutive sentences from it, and the shortest run up to it, that has at
least `least` words is hashed.  A repeated passage of whole sentences with at least `least`
words is covered by such runs to its ends.  Runs meet over all documents by hash; the first
place of each (smallest doc_id, then position) stays, and the sentences of every other place
are removed.

Each task keeps only the first place of a run that it saw and removes its other places by
itself, so a run that stands in a third of all documents reaches the shuffle once a task.

Null text stays null and an empty one empty.  A text with nothing to remove is left as it is;
else the kept parts of the text stay as they are, without the white space after a removed run.
Rows that repeat an id count as one document.  A null id comes after all others.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, text_bytes, tune
from .tokens import SPACED, Words, _P, _PINV, mix, pack, pack_sorted, pieces, unpack, unpack_sorted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
LEAST = 30
#: Places that a task holds before it deals them out.
HOLD = 1 << 20
_NULL = np.int64(2**63 - 1)
_TABLES: dict = {}


def sentences(w: Words):
    """First and last word (exclusive) of each sentence, its row, and the first sentence of each row."""
    if "end" not in _TABLES:
        _TABLES["end"] = np.zeros(256, bool)
        _TABLES["end"][list(b".!?")] = True
    if not len(w.start):
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(len(w.offs), np.int64)
    last = w.buf[w.end - 1]
    # A word run has no white space, so a sentence can end only with a word or at a line break between words.
    lines = np.concatenate([[0], np.cumsum(w.buf == 10)])
    ends = _TABLES["end"][last]
    ends[:-1] |= (w.row[1:] != w.row[:-1]) | (lines[w.start[1:]] != lines[w.end[:-1]])
    ends[-1] = True
    stop = np.flatnonzero(ends) + 1
    begin = np.concatenate([[0], stop[:-1]])
    row = w.row[begin]
    return begin, stop, row, np.searchsorted(row, np.arange(len(w.offs)))


def runs(w: Words, least: int):
    """hash, row, first and last sentence (exclusive, counted in the row) of every run."""
    begin, stop, row, first = sentences(w)
    k = len(begin)
    if not k:
        return np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3))
    c = np.append(begin, stop[-1])  # words before each sentence
    i = np.arange(k)
    j = np.searchsorted(c, c[i] + least, "left")  # exclusive end of the shortest run from i
    fwd = j <= first[row + 1]
    a = np.searchsorted(c, c[i + 1] - least, "right") - 1  # start of the shortest run up to i
    back = (c[i + 1] >= least) & (a >= first[row])
    s = np.concatenate([i[fwd], a[back]])
    e = np.concatenate([j[fwd], i[back] + 1])
    pair = np.unique(s * np.int64(k + 1) + e)
    s, e = pair // (k + 1), pair % (k + 1)
    n = len(w.start)
    p = np.full(n + 1, _P, np.uint64)
    inv = np.full(n + 1, _PINV, np.uint64)
    p[0] = inv[0] = 1
    p, inv = np.cumprod(p, dtype=np.uint64), np.cumprod(inv, dtype=np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w.hashes() * p[:n], dtype=np.uint64)])
    h = mix((sums[c[e]] - sums[c[s]]) * inv[c[s]] + (c[e] - c[s]).astype(np.uint64) * _U(0xD1B54A32D192ED03))
    r = row[s]
    return h, r, s - first[r], e - first[r]


PLACES = "bucket int, kind int, n int, h binary, doc binary, key binary, s binary, e binary"
_SCHEMA = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), *((c, pa.binary()) for c in ("h", "doc", "key", "s", "e"))])
GONE = "doc_id long, key long, s array<int>, e array<int>"


def _firsts(h, doc, s):
    """Order by hash and place; True for the first place of each hash in that order."""
    order = np.lexsort((s, doc, h))
    return order, np.concatenate([[True], h[order][1:] != h[order][:-1]]) if len(h) else np.zeros(0, bool)


def _pack(bucket, kind, h, doc, key, s, e):
    return (int(bucket), kind, len(h), pack_sorted(h), pack(doc.view(np.uint64)), pack(key.view(np.uint64)), pack(s.astype(np.uint64)), pack(e.astype(np.uint64)))


def _deal(h, doc, key, s, e, buckets: int, kind: int, by) -> list:
    """Packed rows of places by bucket of `by`; sorted by hash within each."""
    b = ((by >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    order = np.lexsort((h, b))
    h, doc, key, s, e, b = h[order], doc[order], key[order], s[order], e[order], b[order]
    cuts = np.flatnonzero(np.diff(b, prepend=-1, append=buckets)) if len(b) else np.zeros(1, np.int64)
    return [_pack(b[x] + (buckets if kind else 0), kind, h[x:y], doc[x:y], key[x:y], s[x:y], e[x:y]) for x, y in zip(cuts[:-1], cuts[1:])]


def _split(h, doc, key, s, e, buckets: int) -> pa.RecordBatch:
    """What a task saw: first places go on to meet others (kind 0), the rest is removed (kind 1)."""
    order, new = _firsts(h, doc, s)
    h, doc, key, s, e = h[order], doc[order], key[order], s[order], e[order]
    # Rows that repeat an id are one document: the same place in each stays.
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    stays = (doc == doc[lead]) & (s == s[lead]) & (doc != _NULL) | new
    rows = _deal(h[stays], doc[stays], key[stays], s[stays], e[stays], buckets, 0, h[stays])
    g = ~stays
    rows += _deal(h[g], doc[g], key[g], s[g], e[g], buckets, 1, mix(doc[g].view(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _SCHEMA.types[i]) for i in range(8)], schema=_SCHEMA)


def _places(least: int, buckets: int):
    def run(it):
        held, size = [], 0
        for batch in it:
            for part in pieces(batch, "text"):
                h, row, s, e = runs(Words(part.column("text")), least)
                doc = np.array(part.column("doc_id").cast(pa.int64()).fill_null(int(_NULL)))[row]
                held.append((h, doc, np.array(part.column("key"))[row], s, e))
                size += len(h)
                if size >= HOLD:
                    yield _split(*map(np.concatenate, zip(*held)), buckets)
                    held, size = [], 0
        if size:
            yield _split(*map(np.concatenate, zip(*held)), buckets)

    return run


def _read(table: pa.Table):
    out = [[] for _ in range(5)]
    for n, *blobs in zip(*(table.column(c).to_pylist() for c in ("n", "h", "doc", "key", "s", "e"))):
        out[0].append(unpack_sorted(blobs[0], n))
        for to, blob in zip(out[1:], blobs[1:]):
            to.append(unpack(blob, n).view(np.int64))
    return [np.concatenate(x) for x in out]


def _meet(buckets: int):
    """Of each bucket's places, those that aren't first; what tasks removed passes through."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py():
            return table
        return pa.Table.from_batches([_others(*_read(table), buckets)], schema=_SCHEMA)

    return run


def _others(h, doc, key, s, e, buckets):
    order, new = _firsts(h, doc, s)
    h, doc, key, s, e = h[order], doc[order], key[order], s[order], e[order]
    lead = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    g = ~((doc == doc[lead]) & (s == s[lead]) & (doc != _NULL) | new)
    rows = _deal(h[g], doc[g], key[g], s[g], e[g], buckets, 1, mix(doc[g].view(np.uint64)))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _SCHEMA.types[i]) for i in range(8)], schema=_SCHEMA)


def _by_document(table: pa.Table) -> pa.Table:
    """One row for each document: its removed sentence ranges, merged."""
    _, doc, key, s, e = _read(table)
    order = np.lexsort((e, s, key, doc))
    doc, key, s, e = doc[order], key[order], s[order], e[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1])]))
    rows = []
    for x, y in zip(new, np.append(new[1:], len(doc))):
        reach = np.maximum.accumulate(e[x:y])
        gap = np.concatenate([[True], s[x + 1 : y] > reach[:-1]])
        rows.append((None if doc[x] == _NULL else int(doc[x]), int(key[x]), s[x:y][gap].tolist(), reach[np.append(np.flatnonzero(gap)[1:] - 1, y - x - 1)].tolist()))
    return pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "key": pa.array([r[1] for r in rows], pa.int64()), "s": pa.array([r[2] for r in rows], pa.list_(pa.int32())), "e": pa.array([r[3] for r in rows], pa.list_(pa.int32()))})


def removals(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, key and the removed sentence ranges s, e of every document that loses some."""
    d = docs.where("text is not null").select("doc_id", "text", F.xxhash64("text").alias("key"))
    buckets = max(12, text_bytes(docs) // (1 << 23))
    places = d.mapInArrow(_places(least, buckets), PLACES)
    gone = places.groupBy("bucket").applyInArrow(_meet(buckets), PLACES)
    return gone.groupBy("bucket").applyInArrow(_by_document, GONE)


def _cut(carried: list):
    def run(it):
        for batch in it:
            texts, total, lost = [], [], []
            w = Words(batch.column("text"))
            begin, stop, _, first = sentences(w)
            for i, (text, s, e) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("text", "s", "e")))):
                total.append(int(first[i + 1] - first[i]))
                lost.append(sum(y - x for x, y in zip(s or (), e or ())))
                if s:
                    raw, base, out, at = text.encode(), int(w.offs[i]), [], 0
                    for x, y in zip(s, e):
                        out.append(raw[at : int(w.start[begin[first[i] + x]]) - base])
                        at = int(w.start[stop[first[i] + y - 1]]) - base if y < total[-1] else len(raw)
                    text = b"".join([*out, raw[at:]]).decode().strip()
                texts.append(text)
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in carried]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(total, pa.int64()), pa.array(lost, pa.int64())], names=[*carried, "n_sentences", "n_removed"])

    return run


def dedup(docs: DataFrame, least: int = LEAST, also: tuple = ()) -> DataFrame:
    """doc_id, the columns `also`, text without repeated spans, n_sentences and n_removed of every row."""
    tune(docs.sparkSession)
    names = list(dict.fromkeys(["doc_id", *also, "text"]))
    d = only(docs, *names)
    gone = removals(d.select("doc_id", "text"), least).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "s", "e")
    d = d.join(gone, d["doc_id"].cast("long").eqNullSafe(gone["_id"]) & (F.xxhash64(d["text"]) == gone["_key"]), "left").select(*names, "s", "e")
    schema = d.select(*names).schema.add("n_sentences", "long").add("n_removed", "long")
    return d.mapInArrow(_cut(names), schema)
