"""Deterministic offline text encoder and similarity search.

An encoder is any function from a text Column to an array<double> Column; `hashed` is the
default.  Searches multiply blocks of items with a broadcast query matrix whose size is
checked, and keep only each partition's best rows before the shuffle.
"""

from __future__ import annotations

import hashlib
import re
import sys

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

DIM = 64
#: Query values (rows x dimensions) that one broadcast may hold; more queries go in more blocks.
BLOCK_VALUES = 1 << 21
#: Products of items and queries that a task holds at once, and pieces whose buckets it remembers.
SLICE_VALUES = 1 << 20
KNOWN_PIECES = 200_000
#: Best rows of a query that a task keeps; a larger k leaves all to the shuffle.
MOST_HELD = 10_000


def bucket(piece: str, dim: int = DIM) -> int:
    return int(hashlib.md5(piece.encode()).hexdigest()[:8], 16) % dim


def _pieces(text: str, unit: str) -> list[str]:
    if unit == "word":
        return re.findall("[a-z]+", text.lower())
    return [text[i : i + 3] for i in range(len(text) - 2)]


def hashed(unit: str = "word", dim: int = DIM):
    """Encoder: hashed counts of words, or of character trigrams, at unit length."""

    known: dict = {}

    @F.pandas_udf("array<double>")
    def encode(texts: pd.Series) -> pd.Series:
        out = []
        for t in texts:
            if len(known) > KNOWN_PIECES:
                known.clear()
            pieces = _pieces(t or "", unit)
            for p in set(pieces).difference(known):
                known[p] = bucket(p, dim)
            v = np.bincount([known[p] for p in pieces], minlength=dim).astype(float) if pieces else np.zeros(dim)
            norm = np.sqrt((v * v).sum())
            out.append(v / norm if norm else v)
        return pd.Series(out)

    return encode


def _blocks(queries: DataFrame, k: int = 0):
    """(ids, matrix) of queries(q, v), block by block: at most BLOCK_VALUES numbers or so each."""
    rows = queries.count()
    dim = DIM if rows == 0 else len(queries.select("v").first()[0])
    blocks = max(1, -(-rows * max(dim, 4 * k) // BLOCK_VALUES))
    for b in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b)
        local = part.select("q", F.col("v").cast("array<double>")).toArrow().combine_chunks()
        v = pc.list_flatten(local["v"]).to_numpy().reshape(len(local), dim)
        yield local["q"].to_numpy(), v


def _products(batch: pa.RecordBatch, m: np.ndarray, confidence: str | None = None):
    """(item values, rounded products) of a batch with the queries, at most SLICE_VALUES or one item's at once."""
    if not len(batch) or not len(m):
        return
    v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
    items = batch.column("item").to_numpy(zero_copy_only=False)
    step = max(1, SLICE_VALUES // len(m))
    for at in range(0, len(batch), step):
        s = v[at : at + step] @ m.T
        if confidence:
            s *= batch.column(confidence).to_numpy(zero_copy_only=False)[at : at + step, None]
        np.round(s, 6, out=s)
        s += 0.0
        yield items[at : at + step], s


class _Best:
    """The best k rows of each of n queries so far, ties by item."""

    def __init__(self, n: int, k: int):
        self.n, self.k, self.kth, self.parts, self.held = n, k, np.full(n, -np.inf), [], 0

    def add(self, items: np.ndarray, s: np.ndarray) -> None:
        keep = s >= self.kth
        if len(s) > self.k and keep.sum() > 4 * self.n * self.k:
            np.maximum(self.kth, np.partition(s, len(s) - self.k, axis=0)[len(s) - self.k], out=self.kth)
            keep = s >= self.kth
        i, j = np.nonzero(keep)
        self.parts.append((j, items[i], s[i, j]))
        self.held += len(i)
        if self.held > 2 * self.n * self.k + SLICE_VALUES // 4:
            self.trim()

    def trim(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, item, score = (np.concatenate([p[c] for p in self.parts]) for c in range(3))
        rank = np.unique(item, return_inverse=True)[1]
        order = np.lexsort((rank, -score, q))
        place = np.arange(len(q)) - np.searchsorted(q[order], np.arange(self.n))[q[order]]
        last = order[place == self.k - 1]
        self.kth[q[last]] = score[last]
        order = order[place < self.k]
        self.parts, self.held = [(q[order], item[order], score[order])], len(order)
        return self.parts[0]


def similarities(queries: DataFrame, items: DataFrame, k: int | None = None, floor: float | None = None, confidence: str | None = None, least: bool = False) -> DataFrame:
    """(q, item, score) of queries(q, v) against items(item, v): exact dot products, rounded to 6 places.

    Items keep their columns' names; `confidence` names an item column that multiplies the score.
    With k, the best k of each query remain, ties by item; with `least`, its lowest score as well.
    A task holds a slice of the products, and with k its best rows."""
    q_type, i_type = queries.schema["q"].dataType, items.schema["item"].dataType
    cols = ["item", F.col("v").cast("array<double>").alias("v")] + ([confidence] if confidence else [])
    out = None
    held = k is not None and k <= MOST_HELD  # with more, all rows go on to the window
    for block in _blocks(queries, k if held else 0):
        ids = queries.sparkSession.sparkContext.broadcast(block)

        def run(it, ids=ids):
            names, m = ids.value
            best, low, kinds = _Best(len(names), k) if held else None, None, None
            for batch in it:
                kinds = batch.schema.field("item").type
                for item, s in _products(batch, m, confidence):
                    if least and held:
                        order = np.argsort(item, kind="stable")[::-1]
                        at = order[s[order].argmin(axis=0)]
                        value, who = s[at, np.arange(s.shape[1])], item[at]
                        if low is None:
                            low = [value, who]
                        else:
                            less = (value < low[0]) | ((value == low[0]) & (who > low[1]))
                            low = [np.where(less, value, low[0]), np.where(less, who, low[1])]
                    if floor is not None:
                        s = np.where(s >= floor, s, -np.inf)
                    if best:
                        best.add(item, s)
                        continue
                    i, j = np.nonzero(s > -np.inf)
                    yield _table(names[j], item[i], s[i, j], kinds)
            if best and best.parts:
                j, item, s = best.trim()
                real = s > -np.inf
                rows = pd.DataFrame({"q": j[real], "item": item[real], "score": s[real]})
                if least:
                    rows = pd.concat([rows, pd.DataFrame({"q": np.arange(len(names)), "item": low[1], "score": low[0]})]).drop_duplicates(["q", "item"])
                for at in range(0, len(rows), 1 << 16):
                    part = rows.iloc[at : at + (1 << 16)]
                    yield _table(names[part["q"].to_numpy()], part["item"].to_numpy(), part["score"].to_numpy(), kinds)

        schema = f"q {q_type.simpleString()}, item {i_type.simpleString()}, score double"
        got = items.select(*cols).mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    if k is not None:
        w = Window.partitionBy("q")
        last = F.row_number().over(w.orderBy("score", F.col("item").desc())) == 1
        first = F.row_number().over(w.orderBy(F.col("score").desc(), "item")) <= k
        out = out.withColumn("_keep", (first | last) if least else first).where("_keep").drop("_keep")
    return out


def _table(q: np.ndarray, item: np.ndarray, score: np.ndarray, kind: pa.DataType, name: str = "score") -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(item, kind), pa.array(score, pa.float64())], names=["q", "item", name])


def scaled(queries: DataFrame, items: DataFrame) -> DataFrame:
    """(q, item, norm): the similarities of all pairs, min-max by query.

    The products are made twice, first for each query's ends; so no pair is held or shuffled."""
    q_type, i_type = queries.schema["q"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
    items = items.select("item", F.col("v").cast("array<double>").alias("v"))
    context, out = queries.sparkSession.sparkContext, None
    for names, m in _blocks(queries):
        ids = context.broadcast((names, m))

        def ends(it, ids=ids):
            names, m = ids.value
            lo, hi = np.full(len(names), np.inf), np.full(len(names), -np.inf)
            for batch in it:
                for _, s in _products(batch, m):
                    np.minimum(lo, s.min(axis=0), out=lo)
                    np.maximum(hi, s.max(axis=0), out=hi)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(names))), pa.array(lo), pa.array(hi)], names=["i", "lo", "hi"])

        both = items.mapInArrow(ends, "i long, lo double, hi double").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").toArrow()
        limits = context.broadcast((both["lo"].to_numpy(), both["hi"].to_numpy()))

        def run(it, ids=ids, limits=limits):
            names, m = ids.value
            lo, hi = limits.value
            for batch in it:
                for item, s in _products(batch, m):
                    norm = np.where(hi == lo, 1.0, (s - lo) / np.where(hi == lo, 1.0, hi - lo))
                    yield _table(np.tile(names, len(item)), np.repeat(item, len(names)), norm.ravel(), batch.schema.field("item").type, "norm")

        got = items.mapInArrow(run, f"q {q_type}, item {i_type}, norm double")
        out = got if out is None else out.unionByName(got)
    return out


def top(scored: DataFrame, by: list[str], k: int, score: str = "score", tie: str = "item", rank: str | None = None) -> DataFrame:
    """Best k rows of each group by (score desc, tie asc)."""
    w = Window.partitionBy(*by).orderBy(F.col(score).desc(), F.col(tie))
    out = scored.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return out.withColumnRenamed("_r", rank) if rank else out.drop("_r")


def minmax(score: Column, by: list[str]) -> Column:
    """Min-max over each group; 1 where all are equal."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(score).over(w), F.max(score).over(w)
    return F.when(hi == lo, F.lit(1.0)).otherwise((score - lo) / (hi - lo))
