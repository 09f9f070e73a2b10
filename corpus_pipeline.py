"""Corpus pipeline: quality rules, near duplicates, repeated spans, test items, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; every stage
but the last returns the columns of `docs`, in their order, extra ones included.  `run` writes
each stage's result as Parquet to the shared folder and reads it back as the next one's
documents.

In every stage: an empty table gives an empty one; texts are read whole, however long; extra
columns go along whatever their names, also names that the operators use themselves.  A row is
told from others by its id and text together, so rows without an id and rows that share an id
are handled one by one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import decontamination, mixing, ngram_jaccard, quality_rules, sentence_spans
from skein.llm.queries import table
from skein.llm.shared import drop_path, new_path

OWN = ("doc_id", "text")


def _apart(docs: DataFrame) -> tuple[DataFrame, dict]:
    """docs with all columns but doc_id and text under names that no operator uses, and their names before."""
    names = {f"_carried{i}": c for i, c in enumerate(docs.columns) if c not in OWN}
    return docs.select(*OWN, *(F.col(f"`{c}`").alias(n) for n, c in names.items())), names


def _back(out: DataFrame, docs: DataFrame, names: dict) -> DataFrame:
    """The columns of docs again."""
    now = {c: n for n, c in names.items()}
    return out.select(*(F.col(now.get(c, c)).alias(c) for c in docs.columns))


def _keyed(docs: DataFrame) -> DataFrame:
    """With `_key`, the same for rows that have both id and text in common."""
    return docs.withColumn("_key", F.xxhash64("doc_id", "text"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null and empty texts go, as they have fewer than 50 words.  Rows with equal texts are kept
    or go together."""
    d, names = _apart(docs)
    judged = quality_rules.judge(d, table(spark, sf_dir, "labels"), also=(*names, "text"))
    return _back(judged.where("kept"), docs, names)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five words, 0.8), the document with the smallest id, one without an id only if all are.

    Ties go to one fixed row by its hash.  Of rows that repeat id and text, one stays.  Null and
    empty texts are near duplicates of nothing."""
    d, names = _apart(docs)
    d = _keyed(d)
    groups = ngram_jaccard.join(d.select(F.col("_key").alias("doc_id"), "text"), n=5, num=80, den=100)
    ids = d.select(F.col("_key").alias("_id"), F.col("doc_id").alias("_doc")).distinct()
    first = groups.join(ids, groups["doc_id"] == ids["_id"]).groupBy("component_id").agg(F.min_by("_id", F.struct(F.col("_doc").isNull(), "_doc", "_id")).alias("_stays"))
    stays = first.select("_stays")
    # The semi join and the choice of one row need the same partitioning, so each text moves once.
    out = d.join(stays, d["_key"] == stays["_stays"], "left_semi").dropDuplicates(["_key"])
    return _back(out, docs, names)


def repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated sentence spans; those of which nothing is left go.

    The place in the document with the smallest id stays, null ids being last.  Null texts stay
    null.  Where text was removed, a column n_chars is counted anew."""
    d, names = _apart(docs)
    cut = sentence_spans.dedup(d, also=tuple(names))
    sized = {n: F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n)) for n, c in names.items() if c == "n_chars"}
    cut = cut.withColumns(sized) if sized else cut
    return _back(cut.where("n_removed = 0 or trim(text) <> ''"), docs, names)


def test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without copies of benchmark items.  Null and empty texts hold none."""
    d, names = _apart(docs)
    d = _keyed(d)
    found = decontamination.contaminated(d.select(F.col("_key").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_hit")).distinct()
    return _back(d.join(found, d["_key"] == found["_hit"], "left_anti"), docs, names)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each document: doc_id, size, source_size, target and taken.

    Null and empty texts have size 0 and give nothing; documents without a source are a source of their own."""
    return mixing.mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeated_spans", repeated_spans), ("test_items", test_items), ("mixture", mixture)]

#: SQL can express neither the fitted ratio nor the alignments; tests/llm has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before, path = path, new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_path(spark, before)
        docs = spark.read.parquet(path)
    return docs
