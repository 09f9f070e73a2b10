"""Build, store, load and extend an index: all that retrieval reads, with stored vectors.

An index is a folder with one Parquet table for each of `STORED`; the others of `TABLES` follow
from these.  Every step reads what the
step before wrote, so a lost executor costs one step at most, and vectors of texts that an
older index has are taken from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.ids import content_hash
from skein.operators import corpus, encode, hypergraph
from skein.operators.incremental import new_documents
from skein.sources import store
from skein.sources.store import load_bundle, try_load_bundle

STORED = ("manifest", "passages", "entities", "passage_sentences", "sentences", "links", "adjacent", "hyperedges")
TABLES = (*STORED, "sentence_entities", "nodes", "edges")
HYPERGRAPH = ("hyperedges", "incidence")


def _vectors(texts: DataFrame, col: str, unit: str, old: DataFrame | None) -> DataFrame:
    """texts with the column v: from `old` where it has the text, else encoded."""
    encoder = encode.hashed(unit)
    if old is None:
        return texts.withColumn("v", encoder(col))
    known = texts.join(old.select(col, "v").dropDuplicates([col]), col, "left")
    new = known.where("v is null").drop("v").withColumn("v", encoder(col))
    return known.where("v is not null").unionByName(new).select(*texts.columns, "v")


def build_index(spark: SparkSession, docs: DataFrame, path: str, old: dict | None = None, numbered: DataFrame | None = None) -> dict[str, DataFrame]:
    """Index the documents (doc_id, text) under `path` and return its tables.

    old: the tables of an index whose passages are kept and whose vectors are used again.
    numbered: passages with leading numbers, whose neighbours are linked as well."""

    def put(name: str, df: DataFrame) -> DataFrame:
        return store.put(df, f"{path}/{name}")

    before = lambda name: old[name] if old else None
    hashes = docs.where("text is not null").select(content_hash(F.col("text")).alias("doc_hash")).distinct()
    put("manifest", hashes if old is None else hashes.union(old["manifest"]).distinct())
    texts = corpus.passages(docs)
    if old:
        texts = texts.unionByName(old["passages"].select("passage_id", "text")).dropDuplicates(["passage_id"])
    p = put("passages", _vectors(texts, "text", "word", before("passages")))
    entities = put("entities", _vectors(corpus.lexicon(p).select("entity"), "entity", "gram", before("entities")))
    ps = put("passage_sentences", corpus.passage_sentences(p))
    lists = put("sentences", _vectors(corpus.sentence_lists(ps, entities), "sentence", "word", before("sentences")))
    put("links", corpus.links(corpus.with_entities(p.select("passage_id", "text"), entities)))
    none = spark.createDataFrame([], "src string, dst string, weight double")
    put("adjacent", corpus.adjacent_edges(numbered) if numbered is not None else none)
    put("hyperedges", _vectors(hypergraph.of_lists(lists.select("sentence", "entities")), "sentence", "word", before("hyperedges")))
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a stored index; a missing one raises."""
    t = load_bundle(spark, path, *STORED)
    t["sentence_entities"] = t["sentences"].select("sentence", F.explode("entities").alias("entity"))
    t["nodes"] = corpus.nodes(t["passages"], t["entities"])
    t["edges"] = corpus.edges(corpus.link_edges(t["links"]), t["adjacent"])
    return t


def extend_index(spark: SparkSession, docs: DataFrame, path: str, to: str) -> dict[str, DataFrame]:
    """The index under `path` with the documents that it doesn't have, stored under `to`; its vectors aren't computed again."""
    old = load_index(spark, path)
    return build_index(spark, new_documents(docs, old["manifest"]), to, old)


def cached_hypergraph(spark: SparkSession, sentence_entities: DataFrame, path: str, mode: str = "literal") -> dict[str, DataFrame]:
    """Hyperedges with enhanced scores, and their incidence: loaded if `path` has them, else built and stored there."""
    have = try_load_bundle(spark, path, *HYPERGRAPH)
    if have is None:
        h = hypergraph.enhance(hypergraph.build(sentence_entities), mode)
        h.write.mode("overwrite").parquet(f"{path}/hyperedges")
        h = spark.read.parquet(f"{path}/hyperedges")
        hypergraph.incidence(h).write.mode("overwrite").parquet(f"{path}/incidence")
        have = load_bundle(spark, path, *HYPERGRAPH)
    return have
