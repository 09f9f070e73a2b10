"""From documents to passages, sentences, entities and their long tables."""

from __future__ import annotations

import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import node_id
from skein.functions.text import norm, sentences, tokens
from skein.operators.ordered import ranged

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a lexicon that one broadcast may hold, as hashes of 8 bytes; a larger one is joined.
LEXICON_TOKENS = 1 << 24
RUN = re.compile("[a-z]{5,}")
#: Longest run of letters whose parts are listed, and runs whose parts a task remembers.
LONG_RUN, KNOWN_RUNS = 40, 50_000


def passages(docs: DataFrame) -> DataFrame:
    """Distinct texts with their content id; new text only, as equal texts are one passage."""
    return docs.where(F.col("text").isNotNull()).select("text").distinct().select(node_id("passage", F.col("text")).alias("passage_id"), "text")


def lexicon(p: DataFrame, least: int = 2, share: float = 0.05) -> DataFrame:
    """Gazetteer: tokens that stand in at least `least` passages, and in at most this share of them, so it is the same choice at every size."""
    total = p.agg((F.count(F.lit(1)) * share).alias("most"))  # one row
    df = p.select(F.explode(tokens(F.col("text"))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(total)).where((F.col("df") >= least) & (F.col("df") <= F.col("most"))).select("entity", "df")


def _places(hashes: list[np.ndarray], spark) -> Column:
    """UDF: positions, from 1, of the hashes that stand in a sorted array."""
    known = spark.sparkContext.broadcast(hashes)

    @F.arrow_udf("array<int>")
    def places(lists: pa.Array) -> pa.Array:
        have, flat = known.value, lists.flatten().to_numpy(zero_copy_only=False)
        n = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        hit = have[np.minimum(np.searchsorted(have, flat), len(have) - 1)] == flat if len(have) else np.zeros(len(flat), bool)
        row = np.repeat(np.arange(len(n)), n)
        place = np.arange(len(flat)) - (np.cumsum(n) - n)[row] + 1
        ends = np.concatenate([[0], np.cumsum(np.bincount(row[hit], minlength=len(n)))])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(place[hit], pa.int32()))

    return places.asNondeterministic()  # so that no filter has it run twice


def with_entities(texts: DataFrame, lex: DataFrame, col: str = "text", limit: int = LEXICON_TOKENS) -> DataFrame:
    """texts with `entities`: the text's distinct tokens that the lexicon has.

    A lexicon of up to `limit` tokens goes to the tasks as 64-bit hashes, so no token is
    shuffled; a larger one is joined, by tokens and by a hash of the text."""
    t = texts.withColumn("_tokens", tokens(F.col(col)))
    if lex.count() <= limit:
        hashes = np.sort(lex.select(F.xxhash64("entity").alias("h")).toArrow()["h"].to_numpy())
        t = t.withColumn("_at", _places(hashes, texts.sparkSession)(F.transform("_tokens", lambda x: F.xxhash64(x))))
        return t.withColumn("entities", F.transform("_at", lambda i: F.element_at("_tokens", i))).drop("_tokens", "_at")
    t = t.withColumn("_key", F.sha2(col, 256))
    found = t.select("_key", F.explode("_tokens").alias("entity")).join(lex.select("entity"), "entity", "left_semi").groupBy("_key").agg(F.collect_set("entity").alias("entities"))
    none = F.array().cast("array<string>")
    return t.drop("_tokens").join(found, "_key", "left").withColumn("entities", F.coalesce("entities", none)).drop("_key")


def passage_entities(p: DataFrame, lex: DataFrame) -> DataFrame:
    """passage_id, entity: distinct pairs."""
    return with_entities(p, lex).select("passage_id", F.explode("entities").alias("entity"))


def passage_sentences(p: DataFrame, least: int = 10) -> DataFrame:
    return p.select("passage_id", F.explode(F.array_distinct(sentences(F.col("text"), least))).alias("sentence"))


def sentence_lists(s: DataFrame, lex: DataFrame) -> DataFrame:
    """sentence, entities (sorted, at least one) of each distinct sentence text, wherever it stands."""
    lists = with_entities(s.select("sentence").distinct(), lex, "sentence")
    return lists.select("sentence", F.array_sort("entities").alias("entities")).where(F.size("entities") > 0)


def sentence_entities(s: DataFrame, lex: DataFrame) -> DataFrame:
    """sentence, entity: the lists as rows."""
    return sentence_lists(s, lex).select("sentence", F.explode("entities").alias("entity"))


def _parts(run: str) -> tuple[str, ...]:
    """What a run of letters has inside, from five letters on, without itself."""
    n = len(run)
    return tuple({run[i : i + k] for k in range(5, n) for i in range(n - k + 1)})


def count_in(text: str, entities: list[str], known: dict) -> list[int]:
    """Non-overlapping, case-sensitive count of each entity in a text that is read once.

    An entity of five or more small letters can only stand inside a run of such; other entities
    are looked up one by one.  known: parts of runs met before."""
    plain = {e: 0 for e in entities if RUN.fullmatch(e)}
    lengths = None
    for run, times in Counter(RUN.findall(text)).items() if plain else ():
        if run in plain:
            plain[run] += times
        if len(run) <= 5:
            continue
        if len(run) > LONG_RUN:
            lengths = lengths or {len(e) for e in plain}
            parts = {run[i : i + k] for k in lengths if k < len(run) for i in range(len(run) - k + 1)}
        elif (parts := known.get(run)) is None:
            if len(known) >= KNOWN_RUNS:
                known.clear()
            parts = known[run] = _parts(run)
        for e in parts:
            if e in plain:
                plain[e] += times * run.count(e)
    return [plain[e] if e in plain else text.count(e) if e else 0 for e in entities]


def counts() -> Column:
    """UDF: `count_in` of texts and lists of entities."""
    known: dict = {}

    @F.arrow_udf("array<bigint>")
    def count(texts: pa.Array, lists: pa.Array) -> pa.Array:
        return pa.array([count_in(t or "", e or [], known) for t, e in zip(texts.to_pylist(), lists.to_pylist())], pa.list_(pa.int64()))

    return count.asNondeterministic()


def weighted(listed: DataFrame) -> DataFrame:
    """passage_id, entity, cnt, weight from (passage_id, text, entities): case-sensitive counts, normalised by passage; all within the passage's row."""
    c = listed.select("passage_id", "entities", counts()("text", "entities").alias("cnt"))
    c = c.select("passage_id", F.filter(F.arrays_zip("entities", "cnt"), lambda x: x["cnt"] > 0).alias("x"))
    c = c.select("passage_id", "x", F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["cnt"]).alias("total"))  # once a passage, so before the rows are made
    c = c.select("passage_id", "total", F.explode("x").alias("x"))
    return c.select("passage_id", F.col("x.entities").alias("entity"), "x.cnt", (F.col("x.cnt") / F.col("total")).alias("weight"))


def links(listed: DataFrame) -> DataFrame:
    """passage_id, entities, weights: the edges of `weighted` as one row for each passage."""
    known: dict = {}

    @F.arrow_udf("struct<entities:array<string>,weights:array<double>>")
    def link(texts: pa.Array, lists: pa.Array) -> pa.Array:
        entities, weights = [], []
        for t, e in zip(texts.to_pylist(), lists.to_pylist()):
            got = [(x, n) for x, n in zip(e or [], count_in(t or "", e or [], known)) if n]
            total = sum(n for _, n in got)
            entities.append([x for x, _ in got])
            weights.append([n / total for _, n in got])
        return pa.StructArray.from_arrays([pa.array(entities, pa.list_(pa.string())), pa.array(weights, pa.list_(pa.float64()))], ["entities", "weights"])

    return listed.select("passage_id", link.asNondeterministic()("text", "entities").alias("x")).select("passage_id", "x.entities", "x.weights")


def link_edges(linked: DataFrame) -> DataFrame:
    """passage_id, entity, weight of links."""
    x = F.arrays_zip("entities", "weights")
    return linked.select("passage_id", F.explode(x).alias("x")).select("passage_id", F.col("x.entities").alias("entity"), F.col("x.weights").alias("weight"))


def entity_edges(p: DataFrame, pe: DataFrame) -> DataFrame:
    """As `weighted`, from passages and (passage_id, entity)."""
    lists = pe.groupBy("passage_id").agg(F.collect_set("entity").alias("entities"))
    return weighted(p.select("passage_id", "text").join(lists, "passage_id"))


def adjacent_edges(numbered: DataFrame) -> DataFrame:
    """src, dst, weight 1 between passages with consecutive leading numbers `12:`; numeric order.

    Numbers are dealt in ranges and each range's first row looks up the next range's, so no
    task sees more than one range."""
    n = numbered.select("passage_id", F.regexp_extract("text", r"^(\d+):", 1).alias("n")).where("n <> ''").select("passage_id", F.col("n").cast("long").alias("n"))
    parts = ranged(n, "n", "passage_id")
    w = Window.partitionBy("_part").orderBy("n", "passage_id")
    parts = parts.withColumn("next", F.lead("passage_id").over(w)).withColumn("rn", F.row_number().over(w))
    heads = parts.where("rn = 1").select("_part", F.col("passage_id").alias("head"))
    following = heads.withColumn("before", F.lag("_part").over(Window.orderBy("_part"))).where("before is not null").select(F.col("before").alias("_part"), "head")
    joined = parts.join(F.broadcast(following), "_part", "left")  # one row a range
    return joined.select(F.col("passage_id").alias("src"), F.coalesce("next", "head").alias("dst"), F.lit(1.0).alias("weight")).where("dst is not null")


def numbered(chunks: DataFrame, idx: str, text: str) -> DataFrame:
    """`idx:text` passages."""
    t = F.concat(F.col(idx).cast("string"), F.lit(":"), norm(F.col(text)))
    return chunks.select(node_id("passage", t).alias("passage_id"), t.alias("text"))


def nodes(p: DataFrame, entities: DataFrame) -> DataFrame:
    """id, kind, content of all passages and entities."""
    e = entities.select(node_id("entity", F.col("entity")).alias("id"), F.lit("entity").alias("kind"), F.col("entity").alias("content")).distinct()
    return p.select(F.col("passage_id").alias("id"), F.lit("passage").alias("kind"), F.col("text").alias("content")).unionByName(e)


def edges(weighted: DataFrame, adjacent: DataFrame | None = None) -> DataFrame:
    """src, dst, weight without self loops; between the same two nodes the last kind wins."""
    e = weighted.select(F.col("passage_id").alias("src"), node_id("entity", F.col("entity")).alias("dst"), "weight")
    if adjacent is not None:
        e = e.unionByName(adjacent.select("src", "dst", "weight"))
    return e.where("src <> dst")
