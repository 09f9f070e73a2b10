"""Incremental indexing: new documents, manifest, keyed caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import content_hash
from skein.functions.text import ratio


def new_documents(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Documents whose content hash isn't indexed; duplicates within the batch stay."""
    return docs.where("text is not null").withColumn("doc_hash", content_hash(F.col("text"))).join(manifest.select("doc_hash"), "doc_hash", "left_anti")


def mark_indexed(manifest: DataFrame, hashes: DataFrame, at=None) -> DataFrame:
    """Manifest(doc_hash, indexed_at) with the hashes upserted; the latest time wins."""
    stamp = F.current_timestamp() if at is None else F.lit(at).cast("timestamp")
    both = manifest.select("doc_hash", "indexed_at").unionByName(hashes.select("doc_hash").withColumn("indexed_at", stamp))
    return both.groupBy("doc_hash").agg(F.max("indexed_at").alias("indexed_at"))


def manifest_stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("n_docs"), F.min("indexed_at").alias("created_at"), F.max("indexed_at").alias("updated_at"))


def needs_rebuild(manifest: DataFrame, least: int) -> bool:
    return manifest.count() < least


def clear(manifest: DataFrame) -> DataFrame:
    return manifest.limit(0)


def insert_texts(store: DataFrame, texts: DataFrame, encoder, kind: str) -> DataFrame:
    """Store(hash_id, text, embedding) with new texts encoded and added; equal texts once."""
    from skein.functions.ids import node_id

    new = texts.select("text").distinct().join(store.select("text"), "text", "left_anti")
    return store.unionByName(new.select(node_id(kind, F.col("text")).alias("hash_id"), "text", encoder("text").alias("embedding")))


def process_batches(docs: DataFrame, manifest: DataFrame, process, skip_indexed: bool = True):
    """process(new documents) and the manifest with them marked; the caller writes both."""
    todo = new_documents(docs, manifest) if skip_indexed else docs.where("text is not null").withColumn("doc_hash", content_hash(F.col("text")))
    return process(todo), mark_indexed(manifest, todo)


class Cache:
    """One cache level: a Parquet table keyed by `key`, latest write wins."""

    def __init__(self, spark, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path, schema + ", at timestamp"

    def table(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            t = self.spark.read.schema(self.schema).parquet(self.path)
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)
        w = Window.partitionBy("key").orderBy(F.col("at").desc())
        return t.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")

    def get(self, keys: DataFrame) -> DataFrame:
        """Asked keys with their value, null for misses."""
        return keys.select("key").join(self.table().drop("at"), "key", "left")

    def exists(self, keys: DataFrame) -> DataFrame:
        return keys.select("key").join(self.table().select("key", F.lit(True).alias("hit")), "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))

    def set(self, rows: DataFrame) -> None:
        rows.withColumn("at", F.current_timestamp()).write.mode("append").parquet(self.path)

    def clear(self) -> None:
        self.spark.createDataFrame([], self.schema).write.mode("overwrite").parquet(self.path)


def hit_rate(accesses: DataFrame) -> DataFrame:
    """hits, misses and their rate, 0 without accesses, from (hit)."""
    return accesses.agg(F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).alias("hits"), F.count(F.lit(1)).alias("n")).select("hits", (F.col("n") - F.col("hits")).alias("misses"), F.round(ratio(F.col("hits"), F.col("n")), 6).alias("hit_rate"))
