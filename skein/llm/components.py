"""Connected components of a link table.

Up to `TASK_LINKS` links are joined in one executor task, whose memory that number bounds;
larger tables take alternating large-star and small-star steps, with the edges written to
the shared folder after every round.  Both give the same roots.  Nothing but counts and
checksums reaches the driver.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TASK_LINKS = 1_000_000


def roots_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the smallest node of each one's component."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return ids, ids[label]
        label = new


def _in_task(it):
    parts = [(np.array(b.column(0)), np.array(b.column(1))) for b in it]
    if parts:
        ids, root = roots_of(*(np.concatenate(x).astype(np.int64) for x in zip(*parts)))
        other = ids != root
        yield pa.RecordBatch.from_arrays([pa.array(ids[other]), pa.array(root[other])], names=["node", "root"])


def _large(e: DataFrame) -> DataFrame:
    both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    rest = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return rest.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, task_links: int = TASK_LINKS) -> DataFrame:
    """(node, root) for every node of links(u, v) that isn't the smallest of its component."""
    links = cut(links.select("u", "v"))
    if links.count() <= task_links:
        return links.coalesce(1).mapInArrow(_in_task, "node long, root long")
    e = cut(_small(links))
    last = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == last:
            break
        last = tuple(now)
        e = cut(_small(_large(e)))
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
