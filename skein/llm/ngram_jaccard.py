"""Exact n-gram Jaccard join with a size-aware split into light and heavy sets.

A document's set are its distinct word n-grams.  Documents with equal sets become one node.
Two nodes that link share so many n-grams that they meet within the first few of each set,
in any fixed global order; the order here is by a fixed-size count sketch of the whole
corpus, rarest first, so frequent passages don't bring documents together.

* Light sets (up to `boundary` n-grams) enumerate all 2-subsets of their prefix; light
  pairs must share one.
* Heavy sets scan the inverted lists of their prefix n-grams, in which light sets close to
  the boundary stand too.
* The boundary is the one at which the estimated cost of subsets plus list scans is least.

Lists are packed in numpy arrays, dealt by hash.  In the first pass short lists make all their
pairs; in longer ones, of which some are picked, a member meets up to three others, so the pairs
grow with the sets, however large a group of copies is.  One of them is the list's member whose
rarest n-grams are the most common: the text that copies were made from has none of their edits,
so it links to most of them, and few are left to meet their whole group in the second pass.  Pairs that are met often enough for
the threshold are compared by marks, the parities of a set's n-grams in cells: the cells that
differ are a lower bound of the n-grams that only one of two sets has, so no link is lost.
What the marks allow is verified on whole sets, which are read for these pairs only, best
ones first, and linked nodes are merged after every step, so most pairs of a group of copies
fall away untested.  In the second pass the lists that were too long to make all their pairs
are read again: now all pairs of a list that are still in different components are counted,
kept if position, prefix overlap and marks allow the threshold, and verified.  So every link
between different components is found.  Lists that may have over `HOT` members are split: at random in
the first pass, into blocks of shard pairs in the second.

The prefixes hold if two sets that link have two n-grams in common, which is so above a
threshold of one half; `join` raises below it.

Null or empty text: no n-grams, a component of its own.  A text shorter than n words has its
whole word sequence as one n-gram.  Repeated ids: rows are joined by their sets, an id's
rows each get their own result.  A null id gets the component of its set, null if no id has it.
Sets are compared by 128-bit signatures, n-grams by 64-bit hashes.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import counting
from .components import components
from .shared import Scratch, cut, only, tune
from .tokens import Words, grams, mix, pack, pack_sorted, pieces, unpack, unpack_sorted

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_U = np.uint64
SKETCH = 1 << 23
#: Prefix entries of one packed bucket.
PER_BUCKET = 400_000
#: Lists whose n-gram may stand in more sets than this are split over buckets.
HOT = 1 << 20
#: In the first pass lists of up to NEXT + 1 members make all their pairs; in longer ones, of which some are picked by hash, each member meets the next in size, one further on and the one of the highest rank.
NEXT = 3
#: One in so many of the long lists of 2-subsets is used in the first pass; sets with most n-grams in common share many of them.
PICK = 8
#: In a long list a member also meets one that comes so much later at most.
FAR = 64
#: Added to the count of a pair of the first pass that meets in a long list, where not all that it has in common is counted.
PARTLY = 1 << 32
#: Lists up to this length make their pairs together, longer ones row by row.
SHORT = 32


def sets(col: pa.Array, n: int):
    """Sorted distinct n-gram hashes of each row, in turn."""
    w = Words(col, lower=True)
    h = w.hashes()
    g, at = grams(h, w.row, n)
    row = w.row[at]
    first = np.searchsorted(row, np.arange(len(col) + 1))
    counts = w.counts()
    for i in range(len(col)):
        if counts[i] >= n:
            yield np.unique(g[first[i] : first[i + 1]])
        elif counts[i]:
            k = int(counts[i])
            yield mix(grams(h[w.first[i] : w.first[i + 1]], np.zeros(k, np.int64), k)[0] + _U(k))
        else:
            yield np.zeros(0, np.uint64)


def signature(s: np.ndarray) -> tuple[int, int]:
    if not len(s):
        return 0, 0
    with np.errstate(over="ignore"):
        a = mix(np.array([mix(s ^ _U(0x5851F42D4C957F2D)).sum(dtype=np.uint64) + _U(len(s))]))
        b = mix(np.array([mix(s ^ _U(0x14057B7EF767814F)).sum(dtype=np.uint64) ^ _U(len(s))]))
    return int(a.view(np.int64)[0]), int(b.view(np.int64)[0])


def _cell(s: np.ndarray) -> np.ndarray:
    return (s & _U(SKETCH - 1)).astype(np.int64)


PROFILE = "doc_id long, n long, a long, b long, key string, block int, data binary"


def _profile(n: int):
    def run(it):
        seen = np.zeros(SKETCH, np.int32)
        for batch in it:
            for part in pieces(batch, "text"):
                rows, every = [], []
                for s in sets(part.column("text"), n):
                    rows.append((len(s), *signature(s)))
                    every.append(s)
                if every:
                    np.add.at(seen, _cell(np.concatenate(every)), 1)
                k = len(rows)
                cols = [part.column("doc_id").cast(pa.int64())] + [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(k, pa.string()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=NAMES)
        sums = counting.emit({"sketch": seen})
        k = sums.num_rows
        yield pa.RecordBatch.from_arrays([*(pa.nulls(k, pa.int64()) for _ in range(4)), *sums.columns], names=NAMES)

    return run


NAMES = [x.split()[0] for x in PROFILE.split(", ")]


def need(size, num: int, den: int):
    """Smallest overlap of a set of this size with any set that it links to."""
    return -(-num * size // den)


def _ordered(s: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Rarest first; ties by hash."""
    return s[np.lexsort((s, cells[_cell(s)]))]


def marks(s: np.ndarray) -> bytes:
    """Whether the number of n-grams in each cell is odd; the cells, 64 at least, are the largest power of two up to the size."""
    m = max(64, 1 << (len(s).bit_length() - 1))
    odd = np.bincount(((s >> _U(32)) & _U(m - 1)).astype(np.int64), minlength=m) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """At least so many n-grams are in one of two sets only; the longer marks are folded to the shorter."""
    x, y = (np.frombuffer(v, np.uint8) for v in sorted((a, b), key=len))
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


def _near(num: int, den: int):
    """Pairs whose marks allow the threshold."""

    def run(it):
        for batch in it:
            ok = []
            for na, a, nb, b in zip(*(batch.column(c).to_pylist() for c in ("n_u", "marks_u", "n_v", "marks_v"))):
                both = (na + nb - differ(a, b)) // 2  # at most
                ok.append(den * both >= num * (na + nb - both))
            yield batch.select(["u", "v", "c"]).filter(pa.array(ok, pa.bool_()))

    return run


def _prefixes(n: int, num: int, den: int, cells):
    def run(it):
        c = cells.value
        mean = c.mean()
        for batch in it:
            for part in pieces(batch, "text"):
                ids, keep = part.column("doc_id").to_pylist(), []
                for i, s in enumerate(sets(part.column("text"), n)):
                    if len(s) >= 2:
                        p = _ordered(s, c)[: len(s) - need(len(s), num, den) + 2]
                        scan = float(1 + np.maximum(0, c[_cell(p[:-1])] - mean).sum()) + len(p)
                        keep.append((ids[i], signature(s)[0], len(s), len(p), pack(p), scan, marks(s)))
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in keep], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.binary()))], names=["doc_id", "a", "n", "p", "prefix", "scan", "marks"])

    return run


def boundary_of(sizes: list, num: int, den: int) -> int:
    """Size up to which sets are light: the least total of subsets (light) and list scans (heavy).

    sizes: (n, number of sets, estimated scan cost)."""
    sizes = sorted(sizes)
    best, at, light, heavy = None, 1, 0.0, sum(x[2] for x in sizes)
    best = heavy
    for n, count, scan in sizes:
        p = n - need(n, num, den) + 2
        light += count * p * (p - 1) / 2
        heavy -= scan
        if light + heavy <= best:
            best, at = light + heavy, n
    return at


LISTS = "bucket int, n int, key binary, node binary, size binary, root binary, left binary, rank binary"
PAIRS = "bucket int, n int, u binary, v binary, c binary, nu binary, nv binary"
_TYPES = {"int": pa.int32(), "binary": pa.binary(), "long": pa.int64()}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    spec = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _TYPES[t]) for i, (_, t) in enumerate(spec)], names=[c for c, _ in spec])


def _split(key, own, shards, whole: bool):
    """Row, and list key with the shard mixed in, of entries of hot lists.

    An entry goes to its own random shard, or in the second pass to the block of every pair of shards with its own."""
    at = np.arange(len(key))
    copies = shards if whole else np.ones_like(shards)
    row = np.repeat(at, copies)
    s = shards[row].astype(np.int64)
    mine = (mix(own[row]) % s.astype(np.uint64)).astype(np.int64)
    other = np.arange(len(row)) - np.repeat(np.cumsum(copies) - copies, copies) if whole else mine
    block = (np.minimum(mine, other) * s + np.maximum(mine, other)).astype(np.uint64)
    return row, np.where(s > 1, mix(key[row] + (block + _U(1)) * _U(0x9E3779B97F4A7C15)) & ~_U(1) | key[row] & _U(1), key[row])


def _lists(limit: int, buckets: int, num: int, den: int, cells, whole: bool, hot: int):
    """Entries of the inverted lists, packed by bucket: single n-grams (odd keys) and 2-subsets of light sets (even keys).

    `left` is how many n-grams a set has from the list's n-gram on; of a subset, from its last one on and one more.
    `rank` tells how common a set's rarest n-grams are."""

    def run(it):
        seen = cells.value
        for batch in it:
            key, node, size, root, left, rank, often = [], [], [], [], [], [], []
            for a, n, p, blob, r, scan in zip(*(batch.column(c).to_pylist() for c in ("a", "n", "p", "prefix", "root", "scan"))):
                s = unpack(blob, p)
                k, rest, most = [], [], []
                count = seen[_cell(s)]
                if n > limit or n >= need(limit + 1, num, den):
                    k.append(s[:-1] | _U(1))
                    rest.append(n - np.arange(p - 1))
                    most.append(count[:-1])
                if n <= limit:
                    i, j = np.triu_indices(p, 1)
                    lo, hi = np.minimum(s[i], s[j]), np.maximum(s[i], s[j])
                    k.append(mix(lo * _U(0x9E3779B97F4A7C15) + mix(hi)) & ~_U(1))
                    rest.append(1 + n - j)
                    most.append(np.minimum(count[i], count[j]))
                k = np.concatenate(k)
                key.append(k)
                left.append(np.concatenate(rest))
                often.append(np.concatenate(most))
                node.append(np.full(len(k), a, np.int64))
                size.append(np.full(len(k), n, np.int64))
                root.append(np.full(len(k), r, np.int64))
                rank.append(np.full(len(k), int(16 * np.log2(1 + scan / p)), np.int64))
            if not key:
                continue
            key, node, size, root, left, rank, often = map(np.concatenate, (key, node, size, root, left, rank, often))
            if (often > hot).any():
                row, key = _split(key, node.view(np.uint64), -(-np.maximum(often, 1) // hot), whole)
                node, size, root, left, rank = node[row], size[row], root[row], left[row], rank[row]
            order = np.argsort(key, kind="stable")
            key, node, size, root, left, rank = key[order], *(x[order].astype(np.int64).view(np.uint64) for x in (node, size, root, left, rank))
            b = ((key >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(b, prepend=-1, append=buckets))
            rows = []
            for x, y in zip(cuts[:-1], cuts[1:]):
                rows.append((int(b[x]), int(y - x), pack_sorted(key[x:y]), pack(node[x:y]), pack(size[x:y]), pack(root[x:y] ^ node[x:y]), pack(left[x:y]), pack(rank[x:y])))
            yield _batch(rows, LISTS)

    return run


def _joined(batches):
    """All entries of a bucket by list, size and node."""
    key, node, size, root, left, rank = [], [], [], [], [], []
    for batch in batches:
        for n, k, a, s, r, x, h in zip(*(batch.column(c).to_pylist() for c in ("n", "key", "node", "size", "root", "left", "rank"))):
            key.append(unpack_sorted(k, n))
            node.append(unpack(a, n))
            size.append(unpack(s, n).view(np.int64))
            root.append(unpack(r, n) ^ node[-1])
            left.append(unpack(x, n).view(np.int64))
            rank.append(unpack(h, n).view(np.int64))
    key, node, size, root, left, rank = map(np.concatenate, (key, node, size, root, left, rank))
    order = np.lexsort((node, size, key))
    return key[order], node[order], size[order], root[order], left[order], rank[order]


def _pair_rows(u, v, nu, nv, buckets: int, more: int = 0) -> list:
    """Pairs with their number of common keys plus `more`, packed by bucket."""
    swap = u > v
    u, v, nu, nv = np.where(swap, v, u), np.where(swap, u, v), np.where(swap, nv, nu), np.where(swap, nu, nv)
    b = ((mix(u ^ mix(v)) >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)
    order = np.lexsort((v, u, b))
    u, v, nu, nv, b = u[order], v[order], nu[order], nv[order], b[order]
    new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])) if len(u) else np.zeros(0, np.int64)
    c = np.diff(np.append(new, len(u))) + more
    u, v, nu, nv, b = u[new], v[new], nu[new], nv[new], b[new]
    cuts = np.flatnonzero(np.diff(b, prepend=-1, append=buckets)) if len(b) else np.zeros(1, np.int64)
    return [(int(b[x]), int(y - x), *(pack(z[x:y].astype(np.uint64)) for z in (u, v, c, nu, nv))) for x, y in zip(cuts[:-1], cuts[1:])]


def _some(key, first, length, rank):
    """Index pairs of the first pass, and whether their list is a long one."""
    picked = ((key & _U(1)) == 1) | (mix(key) % _U(PICK) == 0)
    short = np.repeat(length <= NEXT + 1, length)
    end = np.repeat(first + length, length)
    at = np.flatnonzero(short)
    for s in range(1, NEXT + 1):
        at = at[at + s < end[at]]
        yield at, at + s, False
    at = np.flatnonzero(~short & picked)
    head = np.repeat(first, length)[at]
    same = head[1:] == head[:-1]
    yield at[:-1][same], at[1:][same], True
    lead = np.repeat(np.maximum.reduceat(rank << 32 | np.arange(len(key)), first) & 0xFFFFFFFF, length)[at]
    far = np.abs(at - lead) > 1
    yield lead[far], at[far], True
    # Lists of one group have much the same members in the same order, so each list has a distance of its own.
    i = np.arange(len(at))
    j = i + 2 + (mix(~key[at]) % _U(FAR)).astype(np.int64)
    i, j = i[j < len(at)], j[j < len(at)]
    same = head[i] == head[j]
    yield at[i[same]], at[j[same]], True


def _all(first, length, size, root, num: int, den: int):
    """Index pairs of the second pass: all of a list of several components, up to the size bound, but for pairs within its largest one."""
    mixed = (length > 1) & (np.minimum.reduceat(root, first) != np.maximum.reduceat(root, first))
    short, long = mixed & (length <= SHORT), mixed & (length > SHORT)
    at = np.arange(len(root))[np.repeat(short, length)]
    end = np.repeat((first + length)[short], length[short])
    for s in range(1, SHORT):
        at, end = at[at + s < end], end[at + s < end]
        yield at, at + s, False
    for x, m in zip(first[long], length[long]):
        names, which, counts = np.unique(root[x : x + m], return_inverse=True, return_counts=True)
        own = which != counts.argmax()
        sizes = size[x : x + m]
        low, high = np.searchsorted(sizes, need(sizes, num, den), "left"), np.searchsorted(sizes, sizes * den // num, "right")
        for i in np.flatnonzero(own):
            j = np.arange(low[i], high[i])
            j = j[~own[j] | (j > i)]
            yield np.full(len(j), x + i), x + j, False


def _candidates(limit: int, buckets: int, num: int, den: int, whole: bool, most: int = 1 << 20):
    """Pairs that a bucket's lists put forward; in the first pass also (u, u) for each member of a list that couldn't make all its pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, node, size, root, left, rank = _joined(batches)
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        length = np.diff(np.append(first, len(key)))
        hold, held = {False: [], True: []}, 0

        def keep(i, j, partly):
            a, b = size[i], size[j]
            # What both can have in common from here on, and before.  Two light sets meet in the subset of
            # their first two, before which they have nothing; all that a heavy one shares is counted.
            at_most, before = np.minimum(left[i], left[j]), np.minimum(a - left[i], b - left[j])
            single = (key[i] & _U(1)) == 1
            at_most = np.where(single | partly, at_most + before, at_most)
            ok = (at_most >= -(-num * (a + b) // (num + den))) & (root[i] != root[j]) & (~single | partly | (np.maximum(a, b) > limit))
            return i[ok], j[ok]

        def flush():
            for partly, pairs in hold.items():
                if pairs:
                    i, j = (np.concatenate([h[x] for h in pairs]) for x in (0, 1))
                    yield _batch(_pair_rows(node[i], node[j], size[i], size[j], buckets, PARTLY if partly else 0), PAIRS)
                    pairs.clear()

        if not whole:
            i = np.flatnonzero(np.repeat(length > NEXT + 1, length))
            yield _batch(_pair_rows(node[i], node[i], size[i], size[i], buckets), PAIRS)
        for i, j, partly in _all(first, length, size, root, num, den) if whole else _some(key, first, length, rank):
            i, j = keep(i, j, partly)
            if len(i):
                hold[partly].append((i, j))
                held += len(i)
                if held > most:
                    yield from flush()
                    held = 0
        yield from flush()

    return run


def _counted(limit: int, num: int, den: int):
    """Pairs whose number of common prefix n-grams allows the threshold, or isn't known wholly; (u, u) as they are."""

    def run(table: pa.Table) -> pa.Table:
        u, v, c, nu, nv = [], [], [], [], []
        for n, *blobs in zip(*(table.column(x).to_pylist() for x in ("n", "u", "v", "c", "nu", "nv"))):
            for to, blob in zip((u, v, c, nu, nv), blobs):
                to.append(unpack(blob, n).view(np.int64))
        u, v, c, nu, nv = map(np.concatenate, (u, v, c, nu, nv))
        order = np.lexsort((v, u))
        u, v, c, nu, nv = u[order], v[order], c[order], nu[order], nv[order]
        new = np.flatnonzero(np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]))
        c = np.add.reduceat(c, new)
        u, v, nu, nv = u[new], v[new], nu[new], nv[new]
        partly, c = c >= PARTLY, c % PARTLY
        least = -(-num * (nu + nv) // (num + den))
        rest = np.maximum(need(nu, num, den), need(nv, num, den)) - 1
        ok = (c + rest >= least) | (np.maximum(nu, nv) <= limit) | (u == v) | partly
        return pa.table({"u": u[ok], "v": v[ok], "c": c[ok]})

    return run


def _slots(ids: pa.Array, cells: int) -> np.ndarray:
    return (mix(np.array(ids.cast(pa.int64()).fill_null(0)).astype(np.int64).view(np.uint64)) % _U(cells)).astype(np.int64)


def _among(name: str, wanted):
    """Rows whose value may be wanted."""

    def run(it):
        flags = wanted.value
        for batch in it:
            yield batch.filter(pa.array(flags[_slots(batch.column(batch.schema.get_field_index(name)), len(flags))]))

    return run


def _members(n: int, wanted):
    """Whole sets of the rows whose id may be wanted."""

    def run(it):
        flags = wanted.value
        for batch in it:
            for part in pieces(batch, "text"):
                some = part.filter(pa.array(flags[_slots(part.column("doc_id"), len(flags))]))
                if some.num_rows:
                    rows = []
                    for i, s in zip(some.column("doc_id").to_pylist(), sets(some.column("text"), n)):
                        short = np.unique(s >> _U(16))  # 48 bits tell the n-grams of two documents apart
                        rows.append((i, signature(s)[0], len(s), len(short), pack_sorted(short)))
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((*[pa.int64()] * 4, pa.binary()))], names=["doc_id", "a", "n", "m", "grams"])

    return run


def _verify(num: int, den: int):
    def run(it):
        for batch in it:
            ok = []
            for na, ma, a, nb, mb, b in zip(*(batch.column(c).to_pylist() for c in ("n_u", "m_u", "grams_u", "n_v", "m_v", "grams_v"))):
                both = len(np.intersect1d(unpack_sorted(a, ma), unpack_sorted(b, mb), assume_unique=True))
                ok.append(den * both >= num * (na + nb - both))
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _mark_slots(cells: int):
    def run(it):
        flags = np.zeros(cells, np.int64)
        for batch in it:
            flags[_slots(batch.column(0), cells)] = 1
        yield counting.emit({"wanted": flags})

    return run


def _wanted(values: DataFrame):
    """Flags, broadcast, of the slots in which the values of a column fall."""
    cells = 1 << min(23, max(16, int(32 * values.count()).bit_length()))
    flags = counting.collect(values.mapInArrow(_mark_slots(cells), counting.SCHEMA), cells).get("wanted", np.zeros(cells, np.int64))
    return values.sparkSession.sparkContext.broadcast(flags > 0)


def join(docs: DataFrame, n: int = 4, num: int = 85, den: int = 100, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row; sets link at num/den Jaccard or more, which must be over one half."""
    if not den < 2 * num <= 2 * den:
        raise ValueError(f"the threshold must be over 1/2 and at most 1, not {num}/{den}")
    spark = docs.sparkSession
    tune(spark)
    scratch = Scratch(spark)
    d = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    known = scratch.cut(d.mapInArrow(_profile(n), PROFILE))
    rows = cut(known.where("key is null").select("doc_id", "n", "a", "b"))
    sketch = counting.collect(known.where("key is not null").select("key", "block", "data"), SKETCH).get("sketch", np.zeros(SKETCH, np.int64))
    cells = spark.sparkContext.broadcast(np.minimum(sketch, 2**31 - 1).astype(np.int32))
    nodes = scratch.cut(rows.where("n > 0").groupBy("a", "b", "n").agg(F.min("doc_id").alias("rep")))

    texts = d.where("text is not null and doc_id is not null")
    found = texts.mapInArrow(_prefixes(n, num, den, cells), "doc_id long, a long, n long, p long, prefix binary, scan double, marks binary")
    reps = nodes.select(F.col("a").alias("na"), "rep")
    found = found.join(reps, (found["a"] == reps["na"]) & (found["doc_id"] == reps["rep"])).drop("na", "rep")
    found = scratch.cut(found.dropDuplicates(["a", "doc_id"]))  # as the join deals them; a node has one id
    sizes = found.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.sum("scan").alias("scan"), F.sum("p").alias("p")).collect()  # one row for each set size
    limit = boundary_of([(r["n"], r["k"], r["scan"]) for r in sizes], num, den)
    buckets = max(12, sum(r["p"] for r in sizes) // PER_BUCKET)

    def candidates(sets: DataFrame, whole: bool) -> DataFrame:
        lists = sets.select("a", "n", "p", "prefix", "root", "scan").mapInArrow(_lists(limit, buckets, num, den, cells, whole, hot), LISTS)
        packed = lists.groupBy("bucket").applyInArrow(_candidates(limit, buckets, num, den, whole), PAIRS)
        return scratch.cut(packed.groupBy("bucket").applyInArrow(_counted(limit, num, den), "u long, v long, c long"))

    first = candidates(found.withColumn("root", F.col("a")), False)
    pairs, again = first.where("u <> v"), first.where("u = v").select(F.col("u").alias("a"))

    def near(pairs: DataFrame) -> DataFrame:
        """Pairs that may link, by their marks."""
        for x in ("u", "v"):
            pairs = pairs.join(found.select(F.col("a").alias(x), F.col("n").alias(f"n_{x}"), F.col("marks").alias(f"marks_{x}")), x)
        return scratch.cut(pairs.select("u", "v", "c", "n_u", "marks_u", "n_v", "marks_v").mapInArrow(_near(num, den), "u long, v long, c long"))

    def whole_sets(pairs: DataFrame) -> DataFrame:
        """Whole sets of all nodes of these pairs."""
        ids = pairs.select(F.explode(F.array("u", "v")).alias("a")).distinct()
        ids = scratch.cut(ids.join(nodes.select("a", "rep").where("rep is not null"), "a"))
        members = texts.mapInArrow(_members(n, _wanted(ids.select("rep"))), "doc_id long, a long, n long, m long, grams binary")
        of = ids.select(F.col("a").alias("ia"), "rep")
        members = members.join(of, (members["a"] == of["ia"]) & (members["doc_id"] == of["rep"])).dropDuplicates(["a", "doc_id"]).select("a", "n", "m", "grams")
        return scratch.cut(members)

    def verified(pairs: DataFrame, members: DataFrame) -> DataFrame:
        """Links among pairs, on whole sets."""
        for x in ("u", "v"):
            pairs = pairs.join(members.select(F.col("a").alias(x), F.col("n").alias(f"n_{x}"), F.col("m").alias(f"m_{x}"), F.col("grams").alias(f"grams_{x}")), x)
        return scratch.cut(pairs.select("u", "v", "n_u", "m_u", "grams_u", "n_v", "m_v", "grams_v").mapInArrow(_verify(num, den), "u long, v long"))

    def apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
        """Pairs whose nodes are in different components."""
        for x in ("u", "v"):
            pairs = pairs.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r_{x}")), x, "left").withColumn(f"r_{x}", F.coalesce(f"r_{x}", x))
        return pairs.where("r_u <> r_v").select("u", "v", "c")

    def best(pairs: DataFrame) -> DataFrame:
        """For each node, its pair with most in common."""
        to = pairs.groupBy("v").agg(F.max_by("u", F.struct("c", "u")).alias("u")).select("u", "v")
        return to.union(pairs.groupBy("u").agg(F.max_by("v", F.struct("c", "v")).alias("v")).select("u", "v")).distinct()

    pairs = near(pairs)
    members = whole_sets(pairs)
    links, left = None, pairs
    for choose in (best, best, lambda p: p.select("u", "v")):
        todo = scratch.cut(choose(left))
        held = verified(todo, members)
        links = held if links is None else links.union(held)
        roots = scratch.cut(components(links))
        left = scratch.cut(apart(left.join(todo, ["u", "v"], "left_anti"), roots))
    some = found.select("a", "n", "p", "prefix", "scan").mapInArrow(_among("a", _wanted(again)), "a long, n long, p long, prefix binary, scan double")
    rooted = some.join(again, "a", "left_semi").join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    second = near(candidates(rooted, True).join(pairs, ["u", "v"], "left_anti"))
    links = links.union(verified(second.select("u", "v"), whole_sets(second)))
    roots = components(links)
    final = nodes.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
    least = final.groupBy("root").agg(F.min("rep").alias("component_id"))
    final = cut(final.join(least, "root").select(F.col("a").alias("fa"), F.col("b").alias("fb"), "component_id"))
    scratch.close()
    out = rows.join(final, (rows["a"] == final["fa"]) & (rows["b"] == final["fb"]), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
