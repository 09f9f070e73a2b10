"""Benchmark decontamination: rare word seeds, then Smith-Waterman alignment.

Every test item is cut into words (ASCII letters, digits and non-ASCII characters, lower-cased).
The alignment score divided by that of the whole item tells copies, edited and paraphrased ones
included.  Nothing that reaches the score is missed: an alignment that does has a least number
of the item's words, in a least narrow stretch of the document, so of any set of words that
leaves out fewer it has some.  One pass over the training texts counts the item words; each
item takes its rarest ones as that set.  A second pass joins the texts to these seeds; where
enough of them stand close together, and enough words of the whole item do to reach the score,
the words around are aligned with the item.

Items are handled in blocks of at most `BLOCK_WORDS` words, each broadcast; more items make more
blocks, not larger ones.  Texts are never moved.

Null or empty texts and items never match; nor do items without words.  Items of
fewer than twice `FEWEST` words need a score of `FEWEST` words, or of all their words.
Repeated rows and items each give their own pairs.  A null id is carried as null.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import only, tune
from .tokens import Words, byte_class, pieces

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing.
WORD = byte_class((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
#: Words of a copy of a short item.
FEWEST = 4
#: Seeds that must hit, as a share of the item's words.
HITS = 1 / 6
#: Hits that are expanded at once.
AT_ONCE = 1 << 21
MATCH, MISMATCH, GAP = 2, -1, -1
SCORE = 0.5
BLOCK_WORDS = 1 << 20


def smith_waterman(a: np.ndarray, b: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and first and last (exclusive) word of b."""
    n = len(b)
    h, start = np.zeros(n + 1, np.int64), np.arange(n + 1)
    ramp = np.arange(n + 1) * GAP
    best = (0, 0, 0)
    for x in a:
        diag = h[:-1] + np.where(b == x, MATCH, MISMATCH)
        up = h[1:] + GAP
        top = np.concatenate([[0], np.maximum(0, np.maximum(diag, up))])
        from_ = np.concatenate([[0], np.where(diag >= up, start[:-1], start[1:])])
        fresh = top <= 0
        from_[fresh] = np.flatnonzero(fresh)
        lifted = top - ramp
        run = np.maximum.accumulate(lifted)
        src = np.maximum.accumulate(np.where(lifted == run, np.arange(n + 1), 0))
        h, start = run + ramp, from_[src]
        low = h <= 0
        h[low] = 0
        start[low] = np.flatnonzero(low)
        j = int(h.argmax())
        if h[j] > best[0]:
            best = (int(h[j]), int(start[j]), j)
    return best


class Items:
    """Word hashes of one block of test items, and what a copy of each needs to have."""

    def __init__(self, ids: list, texts: list, least: float = SCORE):
        w = Words(pa.array(texts, pa.string()), WORD, lower=True)
        h = w.hashes()
        self.ids = ids
        self.words = [h[a:b] for a, b in zip(w.first[:-1], w.first[1:])]
        self.own = [np.unique(x, return_counts=True) for x in self.words]
        self.known = np.unique(h)
        size = np.array([len(x) for x in self.words], np.int64)
        need = np.maximum(MATCH * least * size, MATCH * np.minimum(size, FEWEST))
        #: Fewest matches of an alignment with such a score, and its most words of a document.
        self.matched = np.ceil(need / MATCH - 1e-9).astype(np.int64)
        self.span = np.floor((MATCH + 1) * size - need + 1e-9).astype(np.int64)
        self.need = need - 1e-9

    def keep_rare(self, counts: dict) -> None:
        """Leave each item its rarest words as seeds, and the number of them that every copy has."""
        seeds, self.hits = [], np.zeros(len(self.words), np.int64)
        for k, (x, m, (own, times)) in enumerate(zip(self.words, self.matched, self.own)):
            if not len(x) or m > len(x):
                continue
            order = np.lexsort((own, [counts.get(int(g), 0) for g in own.view(np.int64)]))
            held = np.cumsum(times[order])
            # The other words cannot make up more than len(x) - held of a copy's matches.
            n = int(np.searchsorted(held, len(x) - m + max(1, min(m, int(HITS * len(x)))))) + 1
            self.hits[k] = held[n - 1] - (len(x) - m)
            seeds.append((own[order[:n]], np.full(n, k)))
        self.seed, self.item = (np.concatenate(c) for c in zip(*seeds)) if seeds else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        order = np.argsort(self.seed, kind="stable")
        self.seed, self.item = self.seed[order], self.item[order]
        self.known = np.unique(self.seed)


def _hits(known: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Indices of the words that are known."""
    if not len(known):
        return np.zeros(0, np.int64)
    return np.flatnonzero(known[np.minimum(np.searchsorted(known, g), len(known) - 1)] == g)


def _word_counts(items):
    def run(it):
        known = cloudpickle.loads(items.value).known
        seen = np.zeros(len(known), np.int64)
        for batch in it:
            for part in pieces(batch, "text"):
                h = Words(part.column("text"), WORD, lower=True).hashes()
                seen += np.bincount(np.searchsorted(known, h[_hits(known, h)]), minlength=len(known))
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(known[k].view(np.int64)), pa.array(seen[k])], names=["word", "n"])

    return run


def _may_score(h: np.ndarray, own: np.ndarray, times: np.ndarray, span: int, need: float) -> bool:
    """Whether some stretch of at most `span` words holds so many of an item's words that it could score `need`.

    With m matches in a stretch of n words, n - m words at least are mismatches or gaps.
    A word counts as often as it stands in the item."""
    i = np.searchsorted(own, h)
    i[i == len(own)] = 0
    at = np.flatnonzero(own[i] == h)
    order = np.argsort(i[at], kind="stable")
    at = at[order]
    word = i[at]
    # Each place counts in stretches that begin after the place `times` places before it of the same word.
    back = np.arange(len(at)) - times[word]
    same = (back >= 0) & (word[back] == word)
    after = np.full(len(h) + span - 1, len(h) + span, np.int64)
    after[at] = np.where(same, at[back], -1)
    counts = np.lib.stride_tricks.sliding_window_view(after, span) < np.arange(len(h))[:, None]
    gain = np.where(counts, np.int32(MATCH), np.int32(max(MISMATCH, GAP)))
    return bool(np.cumsum(gain, axis=1, dtype=np.int32).max() >= need)


def _stretches(items: Items, row: np.ndarray, at: np.ndarray, a: np.ndarray, n: np.ndarray):
    """row, item, first and last word of the stretches that have enough seeds of an item; seeds a to a + n hit word `at`."""
    seed = np.repeat(a - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
    row, at, item = np.repeat(row, n), np.repeat(at, n), items.item[seed]
    order = np.lexsort((at, item, row))
    row, at, item = row[order], at[order], item[order]
    last = np.arange(len(at)) + items.hits[item] - 1
    x = np.flatnonzero(last < len(at))
    y = last[x]
    ok = (row[x] == row[y]) & (item[x] == item[y]) & (at[y] - at[x] < items.span[item[x]])
    x, y = x[ok], y[ok]
    if not len(x):
        return
    row, item, lo, hi = row[x], item[x], at[y] - items.span[item[x]] + 1, at[x] + items.span[item[x]]
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (lo[1:] > hi[:-1])])
    first = np.flatnonzero(new)
    yield from zip(row[first], item[first], lo[first], hi[np.append(first[1:], len(new)) - 1])


def matches(items: Items, col: pa.Array):
    """row, item, score, first word and number of words of every match in a text column."""
    w = Words(col, WORD, lower=True)
    h = w.hashes()
    i = _hits(items.known, h)
    if not len(i):
        return
    a, b = np.searchsorted(items.seed, h[i], "left"), np.searchsorted(items.seed, h[i], "right")
    row, total = w.row[i], np.cumsum(b - a)
    ends = np.append(np.flatnonzero(row[1:] != row[:-1]) + 1, len(row))  # of the hits of each row
    x = 0
    while x < len(row):
        k = np.searchsorted(total[ends - 1], (total[x - 1] if x else 0) + AT_ONCE, "right") - 1
        y = max(int(ends[k]) if k >= 0 else 0, int(ends[np.searchsorted(ends, x, "right")]))
        for r, j, lo, hi in _stretches(items, row[x:y], i[x:y], a[x:y], (b - a)[x:y]):
            words = items.words[j]
            lo, hi = max(lo, w.first[r]), min(hi, w.first[r + 1])
            if not _may_score(h[lo:hi], *items.own[j], int(items.span[j]), items.need[j]):
                continue
            best, s, e = smith_waterman(words, h[lo:hi])
            if best >= items.need[j]:
                yield int(r), int(j), best / (MATCH * len(words)), int(lo - w.first[r] + s), int(e - s)
        x = y


FOUND = "doc_id long, item_id long, score double, first_word long, n_words long"


def _align(items):
    def run(it):
        own = cloudpickle.loads(items.value)
        for batch in it:
            for part in pieces(batch, "text"):
                best: dict = {}
                for row, item, score, first, n in matches(own, part.column("text")):
                    if score > best.get((row, item), (0,))[0]:
                        best[row, item] = (score, first, n)
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[r], own.ids[i], *x) for (r, i), x in sorted(best.items())]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], names=["doc_id", "item_id", "score", "first_word", "n_words"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = SCORE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, score (0 to 1), first_word and n_words (in the document) of every copy of a test item."""
    spark = docs.sparkSession
    tune(spark)
    d = only(docs, "doc_id", "text").where("text is not null").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = only(benchmark, "item_id", "text").where("text is not null")
    total = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-total // block_words))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    out = None
    for k in range(blocks):
        rows = items.where(block == k).orderBy("item_id", "text").collect()  # one block: about block_words words
        own = Items([r["item_id"] for r in rows], [r["text"] for r in rows], least)
        shared = spark.sparkContext.broadcast(cloudpickle.dumps(own))
        counts = d.mapInArrow(_word_counts(shared), "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
        own.keep_rare({r["word"]: r["n"] for r in counts.collect()})  # one number for each word of the block
        found = d.mapInArrow(_align(spark.sparkContext.broadcast(cloudpickle.dumps(own))), FOUND)
        out = found if out is None else out.unionByName(found)
    return out
