"""Set-oriented retrieval: seeds, activation, passage weights, PageRank, hyperedges, reranking.

Everything works on all questions at once; ties are broken by id, and scores that decide a
rank are rounded to 6 places first.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions.ids import node_id
from skein.functions.text import clinical_factor, clinical_keywords, tokens, truncate
from skein.sources.store import cut

from . import corpus, encode, graph

cloudpickle.register_pickle_by_value(sys.modules[__name__])


#: Rows of a join's small side that are sent to all tasks; more are dealt.
FEW_ROWS = 200_000


@dataclass(frozen=True)
class Config:
    """Defaults are part of the semantics."""

    top_k: int = 3
    max_iterations: int = 2
    iteration_threshold: float = 0.3
    top_k_sentence: int = 5
    sentence_floor: float = 0.25
    tier_decay: float = 0.7
    candidate_pool: int = 500
    passage_ratio: float = 0.7
    passage_node_weight: float = 1.0
    damping: float = 0.85
    hyperedge_top_k: int = 30
    hyperedge_threshold: float = 0.3
    hyperedge_entity_boost: float = 1.2
    hyperedge_node_weight: float = 1.2
    context_hyperedges: int = 5


# Presets of the tuning study, for `retrieve`: candidate pool, iterations and threshold.
PRESETS = {"baseline": Config(candidate_pool=10**9), "quick_fix": Config(candidate_pool=200), "balanced": Config(), "aggressive": Config(candidate_pool=200, top_k_sentence=3)}


def seeds(questions: DataFrame, entities: DataFrame) -> DataFrame:
    """q, mention, entity, score: the most similar stored entity of each mention; no floor.

    questions(q, text), entities(entity), with stored vectors v or without; mentions are the question's tokens."""
    enc = encode.hashed("gram")
    m = questions.select("q", F.explode(tokens(F.col("text"))).alias("mention"))
    texts = cut(m.select(F.col("mention").alias("q")).distinct().withColumn("v", enc("q")))
    items = entities.select(F.col("entity").alias("item"), "v") if "v" in entities.columns else entities.select(F.col("entity").alias("item"), enc("entity").alias("v"))
    best = encode.similarities(texts, items, k=1)
    return m.join(best.select(F.col("q").alias("mention"), F.col("item").alias("entity"), "score"), "mention").select("q", "mention", "entity", "score")


def seed_scores(s: DataFrame) -> DataFrame:
    """q, entity, score, pos: one row for each seed; a repeated one keeps its last score, by mention."""
    last = s.groupBy("q", "entity").agg(F.max_by("score", "mention").alias("score"))
    return last.withColumn("pos", F.row_number().over(Window.partitionBy("q").orderBy("entity")))


def activate(seed: DataFrame, sentence_entities: DataFrame, sims: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """Spreading activation: (q, entity, score, tier) and additive (q, entity, weight).

    seed(q, entity, score, pos); sims(q, sentence, sim)."""
    lists = sentence_entities.groupBy("sentence").agg(F.array_sort(F.collect_set("entity")).alias("members"))

    def near(frontier: DataFrame) -> DataFrame:
        found = frontier.join(sentence_entities, "entity").join(sims, ["q", "sentence"]).where(F.col("sim") >= cfg.sentence_floor)
        return found.join(lists, "sentence").select("q", "entity", "sentence", "sim", "members")

    return _spread(seed, near, cfg)


def activate_near(seed: DataFrame, lists: DataFrame, questions: DataFrame, cfg: Config = Config()) -> tuple[DataFrame, DataFrame]:
    """As `activate`, on lists(sentence, entities, maybe v) and questions(q, v).

    Only a question's sentences with an entity of its frontier are compared with it, in one pass
    over the lists, and of these each entity's best `most`: those before it can't claim more."""
    key = F.xxhash64("sentence")

    def near(frontier: DataFrame) -> DataFrame:
        few = frontier.groupBy("entity").agg(F.collect_list("q").alias("qs"), F.collect_list("most").alias("mosts"))
        few = F.broadcast(few) if frontier.count() <= FEW_ROWS else few
        met = lists.withColumn("entity", F.explode("entities")).join(few, "entity")
        met = encoded(met, "sentence").select("entity", "qs", "mosts", key.alias("key"), F.col("v").cast("array<double>").alias("v"))
        q, out = questions.schema["q"].dataType.simpleString(), None
        for block in encode._blocks(questions.select("q", "v")):
            got = met.mapInArrow(_closest(questions.sparkSession.sparkContext.broadcast(block), cfg.sentence_floor), f"q {q}, entity string, most int, key long, sim double")
            out = got if out is None else out.unionByName(got)
        w = Window.partitionBy("q", "entity").orderBy(F.col("sim").desc())
        best = cut(out.withColumn("_r", F.rank().over(w)).where("_r <= most").drop("_r"))
        texts = beside(best.select("key").distinct(), lists.select(key.alias("key"), "sentence", F.col("entities").alias("members")), "key")
        r = F.row_number().over(w.orderBy(F.col("sim").desc(), "sentence"))
        return best.join(texts, "key").withColumn("_r", r).where("_r <= most").select("q", "entity", "sentence", "sim", "members")

    return _spread(seed, near, cfg)


def _closest(block, floor: float):
    """(q, entity, most, key, sim) of sentences that reach the floor: of each question and entity the best `most` in a stretch of this task, and those that are as good."""
    def run(it):
        names, m = block.value
        at = {x: i for i, x in enumerate(names.tolist())}
        held: list = []

        def best() -> pa.RecordBatch:
            rows = pd.concat(held)
            held.clear()
            rows = rows[rows.groupby(["q", "entity"])["sim"].rank(method="min", ascending=False) <= rows["most"]]
            return pa.RecordBatch.from_arrays([pa.array(rows["q"].to_numpy()), pa.array(rows["entity"], pa.string()), pa.array(rows["most"].to_numpy(), pa.int32()), pa.array(rows["key"].to_numpy(), pa.int64()), pa.array(rows["sim"].to_numpy(), pa.float64())], names=["q", "entity", "most", "key", "sim"])

        for batch in it:
            n = len(batch)
            if not n:
                continue
            v = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
            qs = batch.column("qs")
            row = np.repeat(np.arange(n), pc.list_value_length(qs).to_numpy(zero_copy_only=False))
            asked = qs.flatten().to_numpy(zero_copy_only=False)
            col = np.array([at.get(x, -1) for x in asked.tolist()], int)
            mine = np.flatnonzero(col >= 0)
            sim = np.round(np.einsum("ij,ij->i", v[row[mine]], m[col[mine]]), 6) + 0.0
            mine, sim = mine[sim >= floor], sim[sim >= floor]
            held.append(pd.DataFrame({"q": asked[mine], "entity": batch.column("entity").to_numpy(zero_copy_only=False)[row[mine]], "most": batch.column("mosts").flatten().to_numpy(zero_copy_only=False)[mine], "key": batch.column("key").to_numpy(zero_copy_only=False)[row[mine]], "sim": sim}))
            if sum(map(len, held)) > 1 << 18:
                yield best()
        if held:
            yield best()

    return run


_ENTITY, _USED, _NEAR = 0, 1, 2


def _spread(seed: DataFrame, near, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """Turns of spreading activation.  An entity claims, in seed order, its most similar sentences
    that no earlier one of the question claimed; so a turn walks a question as a whole.

    near(frontier(q, entity, most)) gives (q, entity, sentence, sim, members): at least the best
    `most` sentences of each entity, which is what it may claim and all that others can have before it."""
    q = seed.schema["q"].dataType.simpleString()
    cols = f"q {q}, kind int, name string, score double, tier int, weight double, pos int, live boolean"
    no = F.lit(None)
    state = cut(seed.select("q", F.lit(_ENTITY).alias("kind"), F.col("entity").alias("name"), "score", F.lit(1).alias("tier"), F.col("score").alias("weight"), F.col("pos").cast("int").alias("pos"), F.lit(True).alias("live")))
    for turn in range(1, cfg.max_iterations):
        live = state.where((F.col("kind") == _ENTITY) & F.col("live") & (F.col("score") >= cfg.iteration_threshold))
        if turn > 1 and live.isEmpty():
            break
        used = state.where(F.col("kind") == _USED).groupBy("q").agg(F.count(F.lit(1)).alias("n"))
        before = F.row_number().over(Window.partitionBy("q").orderBy("pos"))
        frontier = cut(live.join(used, "q", "left").select("q", F.col("name").alias("entity"), (cfg.top_k_sentence * before + F.coalesce("n", F.lit(0))).cast("int").alias("most")))
        rows = state.select("*", no.cast("string").alias("entity"), no.cast("array<string>").alias("members"))
        more = near(frontier).select("q", F.lit(_NEAR).alias("kind"), F.col("sentence").alias("name"), F.col("sim").alias("score"), no.cast("int").alias("tier"), no.cast("double").alias("weight"), F.lit(0).alias("pos"), F.lit(False).alias("live"), "entity", "members")
        state = cut(rows.unionByName(more).groupBy("q").applyInPandas(_turn(cfg, turn), cols))
    out = state.where(F.col("kind") == _ENTITY)
    return out.where("tier is not null").select("q", F.col("name").alias("entity"), "score", "tier"), out.where("weight is not null").select("q", F.col("name").alias("entity"), "weight")


def _turn(cfg: Config, turn: int):
    def walk(key, rows):
        mine, found = rows[rows.kind == _ENTITY], rows[rows.kind == _NEAR]
        used = set(rows[rows.kind == _USED]["name"])
        by: dict = {}
        for name, sim, e, members in zip(found["name"], found["score"], found["entity"], found["members"]):
            by.setdefault(e, []).append((-sim, name, list(members)))
        known = mine[mine["tier"].notna()]
        active = dict(zip(known["name"], zip(known["score"], known["tier"].astype(int))))
        known = mine[mine["weight"].notna()]
        weight = dict(zip(known["name"], known["weight"]))
        new: dict = {}
        for e in mine[mine["live"].astype(bool)].sort_values("pos")["name"]:
            score, tier = active[e]
            if score < cfg.iteration_threshold:
                continue
            free = sorted(x for x in by.get(e, ()) if x[1] not in used)[: cfg.top_k_sentence]
            for minus, name, members in free:
                if -minus < cfg.sentence_floor:
                    continue
                used.add(name)
                for n in members:
                    s = score * -minus * (cfg.tier_decay if tier > 1 else 1.0)
                    if s < cfg.iteration_threshold:
                        continue
                    weight[n] = weight.get(n, 0.0) + s
                    new[n] = (s, turn + 1)
        active.update(new)
        place = {n: i for i, n in enumerate(new)}
        names, used = sorted(set(active) | set(weight)), sorted(used)
        u = len(used)
        return pd.DataFrame({"q": key[0], "kind": [_ENTITY] * len(names) + [_USED] * u, "name": names + used, "score": [active.get(n, (None, None))[0] for n in names] + [None] * u, "tier": pd.array([active.get(n, (None, None))[1] for n in names] + [None] * u, "Int32"), "weight": [weight.get(n) for n in names] + [None] * u, "pos": [place.get(n, 0) for n in names] + [0] * u, "live": [n in place for n in names] + [False] * u})

    return walk


def beside(few: DataFrame, many: DataFrame, on: str = "passage_id") -> DataFrame:
    """few.join(many, on), where up to FEW_ROWS rows are sent to the many, which so aren't dealt."""
    few = cut(few)
    return (F.broadcast(few) if few.count() <= FEW_ROWS else few).join(many, on)


def passage_scores(dense: DataFrame, passages: DataFrame, active: DataFrame, cfg: Config = Config()) -> DataFrame:
    """q, passage_id, score: dense similarity and occurrences of activated entities, for the candidates.

    dense(q, passage_id, score) has each question's best candidate_pool passages and its least
    similar one at least, so min-max is over all passages; then the best candidate_pool remain.
    A question's activated entities come as one list, in lower case, as does the text, which is
    read once for all of them."""
    d = dense.withColumn("dpr", encode.minmax(F.col("score"), ["q"]))
    pool = cut(encode.top(d, ["q"], cfg.candidate_pool, tie="passage_id").select("q", "passage_id", "dpr"))
    lists = active.groupBy("q").agg(F.collect_list(F.struct(F.lower("entity").alias("entity"), "score", "tier")).alias("active"))
    texts = cut(beside(pool.select("passage_id").distinct(), passages.select("passage_id", F.lower("text").alias("low"))))
    tasks = 4 * dense.sparkSession.sparkContext.defaultParallelism
    c = pool.join(lists, "q", "left").join(texts, "passage_id").repartition(tasks, "q", "passage_id")
    c = c.withColumn("active", F.coalesce("active", F.array().cast("array<struct<entity:string,score:double,tier:int>>")))
    c = c.withColumn("counts", corpus.counts()("low", F.col("active.entity")))
    each = F.zip_with("active", "counts", lambda a, n: a["score"] * F.log1p(n.cast("double")) / a["tier"])
    bonus = F.aggregate(each, F.lit(0.0), lambda s, x: s + x)
    score = (cfg.passage_ratio * F.col("dpr") + F.log1p(bonus)) * cfg.passage_node_weight
    return c.select("q", "passage_id", F.round(score, 6).alias("score"))


def graph_search(weights, p_scores, nodes, edges, cfg: Config = Config(), k: int | None = None, slack: float = 1.0, links: DataFrame | None = None, task_bytes: int = graph.TASK_BYTES) -> DataFrame:
    """q, passage_id, score by personalised PageRank from entity weights (of spreading activation) and passage weights.

    With k, only passages whose score times `slack` reaches the question's k-th one.  links: the edges
    again, of a graph that has none but between passages and entities; a large one is solved on them."""
    if links is not None and 24 * (links.agg(F.sum(F.size("entities"))).first()[0] or 0) > task_bytes:
        pr = graph.linked_rank(links, weights.select("q", "entity", F.col("weight").alias("w")), p_scores.select("q", "passage_id", F.col("score").alias("w")), cfg.damping, k=k, slack=slack)
        return pr.select("q", "passage_id", F.round("score", 6).alias("score"))
    reset = weights.select("q", node_id("entity", F.col("entity")).alias("id"), F.col("weight").alias("w"))
    reset = reset.unionByName(p_scores.select("q", F.col("passage_id").alias("id"), F.col("score").alias("w")))
    pr = graph.pagerank(nodes, edges, reset, cfg.damping, kind="passage", k=k, slack=slack)
    return pr.select("q", F.col("id").alias("passage_id"), F.round("score", 6).alias("score"))


def hyperedge_retrieve(questions: DataFrame, hyperedges: DataFrame, cfg: Config = Config()) -> DataFrame:
    """q, he_id, sentence, entities, score, rank: similarity times confidence, the best 30 at 0.3 or more."""
    items = encoded(hyperedges, "sentence").select(F.col("he_id").alias("item"), "v", F.col("score").alias("confidence"))
    s = encode.similarities(cut(encoded(questions).select("q", "v")), items, k=cfg.hyperedge_top_k, confidence="confidence")
    s = encode.top(s, ["q"], cfg.hyperedge_top_k, rank="rank").where(F.col("score") >= cfg.hyperedge_threshold)
    return beside(s, hyperedges.select(F.col("he_id").alias("item"), "sentence", "entities"), "item").select("q", F.col("item").alias("he_id"), "sentence", "entities", "score", "rank")


def seed_expansion(found: DataFrame, seed: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """Hyperedges of seed entities (joined by text) that weren't found, at score 0.5, after the others."""
    inc = hyperedges.select("he_id", "sentence", "entities", F.explode("entities").alias("entity"))
    more = beside(seed.select("q", "entity"), inc, "entity").groupBy("q", "he_id").agg(F.first("sentence").alias("sentence"), F.first("entities").alias("entities"))
    more = more.join(found.select("q", "he_id"), ["q", "he_id"], "left_anti").withColumn("score", F.lit(0.5))
    n = found.groupBy("q").agg(F.max("rank").alias("n"))
    w = Window.partitionBy("q").orderBy("he_id")
    more = more.join(F.broadcast(n), "q", "left").withColumn("rank", F.coalesce("n", F.lit(0)) + F.row_number().over(w)).drop("n")  # one row a question
    return found.unionByName(more)


def may_rise(ranked: DataFrame, cfg: Config = Config()) -> DataFrame:
    """Ranked passages that can be among a question's top_k after `boost`, which raises a score by hyperedge_entity_boost at most."""
    return graph.near_top(ranked, cfg.top_k, cfg.hyperedge_entity_boost)


def boost(ranked: DataFrame, passages: DataFrame, found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """q, passage_id, matches, score, rank: times 1 + 0.2 min(m, 3) / 3 for m expanded entities in the passage; stable."""
    e = found.select("q", F.explode("entities").alias("entity")).groupBy("q").agg(F.collect_set("entity").alias("expanded"))
    c = beside(ranked, passages.select("passage_id", F.lower("text").alias("low"))).join(e, "q", "left")
    m = F.coalesce(F.size(F.filter("expanded", lambda x: F.contains(F.col("low"), x))), F.lit(0))
    c = c.withColumn("matches", F.greatest(m, F.lit(0)))
    factor = 1 + (cfg.hyperedge_entity_boost - 1) * F.least(F.col("matches"), F.lit(3)) / 3
    c = c.withColumn("boosted", F.round(F.col("score") * factor, 6))
    w = Window.partitionBy("q").orderBy(F.col("boosted").desc(), "rank")
    return c.select("q", "passage_id", "matches", F.col("boosted").alias("score"), F.row_number().over(w).alias("rank"))


HEADER = "[Medical Knowledge Facts]\n"


def context(found: DataFrame, cfg: Config = Config()) -> DataFrame:
    """q, context: header and up to five numbered texts, each cut to 200 characters and `...`."""
    top = found.where(F.col("rank") <= cfg.context_hyperedges)
    lines = top.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("x"))
    body = F.array_join(F.transform("x", lambda s: F.concat(s["rank"].cast("string"), F.lit(". "), truncate(s["sentence"], 200), F.lit("\n"))), "")
    return lines.select("q", F.concat(F.lit(HEADER), body).alias("context"))


def clinical_rerank(questions: DataFrame, ranked: DataFrame, passages: DataFrame) -> DataFrame:
    """q, passage_id, score, rank after the clinical factors."""
    k = questions.select("q", clinical_keywords(F.col("text")).alias("keywords"))
    c = beside(ranked, passages.select("passage_id", "text")).join(k, "q")
    c = c.select("q", "passage_id", F.round(F.col("score") * clinical_factor(F.col("keywords"), F.col("text")), 6).alias("score"))
    return encode.top(c, ["q"], 2**31 - 1, tie="passage_id", rank="rank")


def encoded(texts: DataFrame, col: str = "text") -> DataFrame:
    """With the column v, the text's vector; a stored one stays."""
    return texts if "v" in texts.columns else texts.withColumn("v", encode.hashed("word")(col))


def dense(questions: DataFrame, passages: DataFrame, k: int | None = None, least: bool = False) -> DataFrame:
    """q, passage_id, score by the vectors of questions and passages; with k the best k of each question, with `least` its least similar one too."""
    items = encoded(passages).select(F.col("passage_id").alias("item"), "v")
    s = encode.similarities(cut(encoded(questions).select("q", "v")), items, k=k, least=least)
    return s.withColumnRenamed("item", "passage_id")


def sentence_sims(questions: DataFrame, sentences: DataFrame, cfg: Config = Config()) -> DataFrame:
    """q, sentence, sim of similarities that reach the floor."""
    items = encoded(sentences, "sentence").select(F.col("sentence").alias("item"), "v")
    s = encode.similarities(cut(encoded(questions).select("q", "v")), items, floor=cfg.sentence_floor)
    return s.select("q", F.col("item").alias("sentence"), F.col("score").alias("sim"))


MODES = ("hybrid", "graph", "dense")


def retrieve(questions: DataFrame, index: dict, mode: str = "hybrid", cfg: Config = Config()) -> DataFrame:
    """One row a question: ranked passages with scores, flags, and in hybrid mode the context before the first passage.

    Questions with seed entities go through graph search (activation, passage weights, PageRank);
    the others, and all in dense mode, are ranked by their vectors, in hybrid mode from a pool of
    2 top_k.  In hybrid mode hyperedges boost the ranking.  index has the tables of `build_index`."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    passages = index["passages"]
    questions = questions.select("q", "text")
    asked = cut(encoded(questions).select("q", "text", "v"))
    none = asked.select("q").limit(0)
    # The graph's scores have many ties and may rise by the boost, so more than top_k go on.
    slack = cfg.hyperedge_entity_boost if mode == "hybrid" else 1.0
    if mode == "dense":
        one, ranked = none, dense(asked, passages, cfg.top_k)
    else:
        one, ranked = _by_graph(asked, index, cfg, slack)
    ranked = cut(encode.top(ranked, ["q"], 2**31 - 1, tie="passage_id", rank="rank"))
    if mode != "hybrid":
        return results(questions, ranked.where(F.col("rank") <= cfg.top_k), passages, one, none.withColumn("context", F.lit("")))
    found = cut(hyperedge_retrieve(asked, index["hyperedges"], cfg))
    best = boost(may_rise(ranked, cfg), passages, found, cfg).where(F.col("rank") <= cfg.top_k)
    return results(questions, best, passages, one, context(found, cfg))


def _by_graph(asked: DataFrame, index: dict, cfg: Config, slack: float) -> tuple[DataFrame, DataFrame]:
    """Seeds, and (q, passage_id, score): by graph search for questions with seeds, by vectors for the others."""
    one = cut(seed_scores(cut(seeds(asked, index["entities"]))))
    active, weights = activate_near(one, index["sentences"], asked.select("q", "v"), cfg)
    d = cut(dense(asked, index["passages"], max(cfg.candidate_pool, 2 * cfg.top_k), least=True))
    g = graph_search(weights, passage_scores(d, index["passages"], active, cfg), index["nodes"], index["edges"], cfg, k=cfg.top_k, slack=slack, links=index["links"] if index["adjacent"].isEmpty() else None)
    without = asked.select("q").join(one.select("q").distinct(), "q", "left_anti")
    pool = encode.top(d.join(without, "q", "left_semi"), ["q"], 2 * cfg.top_k, tie="passage_id")
    # A question without seeds has passage weights too; it keeps its dense pool.
    return one, g.join(without, "q", "left_anti").unionByName(pool.select("q", "passage_id", "score"))


def results(questions, best, passages, seed, ctx) -> DataFrame:
    """question rows with sorted_passage, sorted_passage_scores, has_entities, has_hyperedge_context; the context stands before the first passage."""
    b = beside(best, passages.select("passage_id", "text")).join(ctx, "q", "left")
    text = F.when((F.col("rank") == 1) & F.col("context").isNotNull(), F.concat("context", F.lit("\n"), "text")).otherwise(F.col("text"))
    x = b.select("q", F.struct("rank", text.alias("text"), "score").alias("x")).groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("x"))
    out = questions.join(x, "q", "left").join(seed.select("q").distinct().withColumn("has_entities", F.lit(True)), "q", "left").join(ctx.select("q", F.lit(True).alias("has_hyperedge_context")), "q", "left")
    return out.withColumns({"sorted_passage": F.col("x.text"), "sorted_passage_scores": F.col("x.score"), "has_entities": F.coalesce("has_entities", F.lit(False)), "has_hyperedge_context": F.coalesce("has_hyperedge_context", F.lit(False))}).drop("x")
