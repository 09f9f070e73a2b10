"""Registered queries over the test tables; skein.plans.oracles has their SQL counterparts.

Passages are the distinct documents, questions the benchmark items, and entities a gazetteer
of mid-frequency tokens, so that every operator runs offline.  Searches that walk the graph take
as questions the items whose id is divisible by 20, against the whole index; the others take all."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.ids import content_hash, node_id
from skein.operators import answer as A
from skein.operators import corpus as C
from skein.operators import encode as E
from skein.operators import extract as X
from skein.operators import graph as G
from skein.operators import hypergraph as H
from skein.operators import incremental as I
from skein.operators import retrieve as R
from skein.sources.store import cut, shared_dir, small_batches

from .index import build_index
from .oracles import NOTES, ORACLES  # noqa: F401

CFG = R.Config()
#: Products of rounded numbers can end in an exact half; this settles it the same way in every engine.
HALF = 1e-9
QUERIES: dict = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


class Tables:
    """Frames that several queries share; those used more than once are written once."""

    def __init__(self, spark: SparkSession, sf_dir: str, every: int = 1):
        self.spark, self.dir, self.made, self.every = spark, sf_dir, {}, every
        small_batches(spark)

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _once(self, name, make):
        if name not in self.made:
            self.made[name] = cut(make())
        return self.made[name]

    passages = property(lambda s: s._once("passages", lambda: C.passages(s.read("documents"))))
    lexicon = property(lambda s: s._once("lexicon", lambda: C.lexicon(s.passages)))
    passage_entities = property(lambda s: C.passage_entities(s.passages, s.lexicon))
    sentences = property(lambda s: C.passage_sentences(s.passages))
    sentence_lists = property(lambda s: s._once("sl", lambda: C.sentence_lists(s.sentences, s.lexicon)))
    valid_lists = property(lambda s: s._once("vl", lambda: C.sentence_lists(s.sentences, s.lexicon).where(H.valid(F.col("sentence"), F.size("entities")))))
    entity_edges = property(lambda s: C.weighted(C.with_entities(s.passages, s.lexicon)))
    hyperedges = property(lambda s: H.of_lists(s.made["sl"] if "sl" in s.made else s.valid_lists))
    passage_hyperedges = property(lambda s: H.passage_hyperedges_of(C.with_entities(s.sentences, s.lexicon, "sentence")))
    questions = property(lambda s: s._once("q", lambda: s.read("benchmark").where(F.col("item_id") % s.every == 0).select(F.col("item_id").alias("q"), "text")))
    seeds = property(lambda s: s._once("seeds", lambda: R.seeds(s.questions, s.lexicon)))
    seed_scores = property(lambda s: s._once("seed_scores", lambda: R.seed_scores(s.seeds)))
    found = property(lambda s: s._once("found", lambda: R.hyperedge_retrieve(s.questions, s.hyperedges, CFG)))
    links = property(lambda s: s._once("links", lambda: C.links(C.with_entities(s.passages, s.lexicon))))
    nodes = property(lambda s: C.nodes(s.passages, s.lexicon))
    edges = property(lambda s: C.edges(C.link_edges(s.links)))

    asked = property(lambda s: s._once("asked", lambda: R.encoded(s.questions).select("q", "v")))

    @property
    def activated(self) -> tuple[DataFrame, DataFrame]:
        if "active" not in self.made:
            self.made["active"] = R.activate_near(self.seed_scores, self.sentence_lists, self.asked, CFG)
        return self.made["active"]

    @property
    def scored(self) -> DataFrame:
        d = lambda: R.dense(self.questions, self.passages, CFG.candidate_pool, least=True)
        return self._once("scored", lambda: R.passage_scores(cut(d()), self.passages, self.activated[0], CFG))

    def index(self) -> dict:
        return build_index(self.spark, self.read("documents"), f"{shared_dir(self.spark)}/index-{uuid.uuid4().hex}")


def _vectors(t: Tables) -> tuple[DataFrame, DataFrame]:
    v = t.read("embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").cast("array<double>").alias("v"))
    return v.where("item % 20 = 0").select(F.col("item").alias("q"), "v"), v


@query
def dense_topk(spark, sf_dir):
    q, v = _vectors(Tables(spark, sf_dir))
    return E.top(E.similarities(q, v, k=10), ["q"], 10, rank="rank")


@query
def dense_minmax(spark, sf_dir):
    q, v = _vectors(Tables(spark, sf_dir))
    return E.scaled(q, v).select("q", "item", F.round("norm", 6).alias("norm"))


@query
def candidate_pool(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return E.top(R.dense(t.questions, t.passages, k=CFG.candidate_pool), ["q"], CFG.candidate_pool, tie="passage_id", rank="rank")


@query
def seed_entity_argmax(spark, sf_dir):
    return Tables(spark, sf_dir).seeds


@query
def passage_dedup_ids(spark, sf_dir):
    p = C.passages(Tables(spark, sf_dir).read("documents"))
    return p.select("passage_id", F.length("text").cast("long").alias("n_chars"))


@query
def sentence_split(spark, sf_dir):
    return Tables(spark, sf_dir).sentences.select("passage_id", "sentence")


def _notes(t: Tables) -> DataFrame:
    """doc_id, text: every document with a note behind it, since the invented prose has no medical words to find."""
    note = F.get(F.array(*map(F.lit, NOTES)), F.pmod("doc_id", F.lit(len(NOTES))).cast("int"))
    return t.read("documents").select("doc_id", F.concat(F.coalesce("text", F.lit("")), F.lit(" "), note).alias("text"))


@query
def keyword_entities(spark, sf_dir):
    d = _notes(Tables(spark, sf_dir))
    return d.select("doc_id", F.array_join(T.keyword_entities(F.col("text")), ",").alias("keywords"))


@query
def typed_entities(spark, sf_dir):
    d = _notes(Tables(spark, sf_dir))
    return d.select("doc_id", F.explode(T.typed_entities(F.col("text"))).alias("x")).select("doc_id", F.col("x.text").alias("entity"), F.col("x.type").alias("type"))


@query
def dictionary_entities(spark, sf_dir):
    return _notes(Tables(spark, sf_dir)).select("doc_id", F.array_join(T.dictionary_entities(F.col("text")), ",").alias("entities"))


@query
def gazetteer_entities(spark, sf_dir):
    return Tables(spark, sf_dir).passage_entities.select("passage_id", "entity")


@query
def question_entities(spark, sf_dir):
    t = Tables(spark, sf_dir)
    found = t.questions.select("q", "text", F.explode_outer(T.tokens(F.col("text"))).alias("entity")).join(t.lexicon.select("entity", F.lit(1).alias("k")), "entity", "left")
    lists = found.groupBy("q", "text").agg(F.collect_set(F.when(F.col("k") == 1, F.col("entity"))).alias("found"))
    return lists.select("q", F.array_join(X.question_entities(F.col("found"), F.col("text")), ",").alias("entities"))


@query
def bio_decode(spark, sf_dir):
    p = Tables(spark, sf_dir).passages
    w = F.split("text", " ")
    t = p.select(F.col("passage_id").alias("doc"), F.posexplode(w).alias("pos", "token"))
    before = F.coalesce(F.sum(F.length("token") + 1).over(Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    label = F.when(F.col("token").rlike("^[A-Z]"), "B-NAME").when(F.col("token").contains("th"), "I-NAME").otherwise("O")
    t = t.select("doc", "pos", before.alias("start"), (before + F.length("token")).alias("stop"), label.alias("label"), (1.0 / (1 + F.length("token") % 4)).alias("prob"))
    return X.bio_decode(t, p.select(F.col("passage_id").alias("doc"), "text"))


@query
def passage_entity_edges(spark, sf_dir):
    return Tables(spark, sf_dir).entity_edges.select("passage_id", "entity", "cnt", F.round("weight", 6).alias("weight"))


@query
def adjacent_edges(spark, sf_dir):
    return C.adjacent_edges(C.numbered(Tables(spark, sf_dir).read("documents"), "doc_id", "text"))


@query
def graph_node_types(spark, sf_dir):
    return G.node_types(Tables(spark, sf_dir).nodes)


@query
def graph_degree_stats(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return G.degree_distribution(C.nodes(t.passages, t.lexicon), C.edges(t.entity_edges))


@query
def edge_weight_stats(spark, sf_dir):
    return G.weight_stats(C.edges(Tables(spark, sf_dir).entity_edges), "weight")


@query
def score_stats(spark, sf_dir):
    return G.weight_stats(Tables(spark, sf_dir).read("events"), "value")


@query
def connected_components(spark, sf_dir):
    t = Tables(spark, sf_dir)
    # Passages and the hyperedges of their sentences.
    c = H.component_sizes(t.passages, t.passage_hyperedges)
    return c.groupBy("n_nodes").agg(F.count(F.lit(1)).alias("n_components"), F.min("first").alias("first"))


@query
def hyperedges_build(spark, sf_dir):
    return Tables(spark, sf_dir).hyperedges.select("he_id", "sentence", F.array_join("entities", "|").alias("entities"), "n_entities", "score")


@query
def hyperedge_types_inferred(spark, sf_dir):
    h = H.enhance(Tables(spark, sf_dir).hyperedges, "inferred")
    return h.select("he_id", F.array_join("types", ",").alias("types"), F.col("boost").cast("double").alias("boost"), "score")


@query
def hyperedge_boost_literal(spark, sf_dir):
    return H.enhance(Tables(spark, sf_dir).hyperedges, "literal").select("he_id", F.col("boost").cast("double").alias("boost"), "score")


@query
def hypergraph_incidence(spark, sf_dir):
    return H.incidence(Tables(spark, sf_dir).hyperedges)


@query
def hypergraph_stats(spark, sf_dir):
    h = Tables(spark, sf_dir).hyperedges
    return H.stats(h, H.incidence(h))


@query
def passage_hyperedges(spark, sf_dir):
    return Tables(spark, sf_dir).passage_hyperedges


@query
def hyperedge_retrieve(spark, sf_dir):
    return Tables(spark, sf_dir).found.select("q", "he_id", "score", "rank")


@query
def hyperedge_seed_expansion(spark, sf_dir):
    t = Tables(spark, sf_dir)
    e = R.seed_expansion(t.found, t.seed_scores, t.hyperedges)
    return e.groupBy("q").agg(F.count(F.lit(1)).alias("n_hyperedges"), F.max("rank").alias("last_rank"), F.round(F.min("score"), 6).alias("least_score"))


def _ranked(t: Tables) -> DataFrame:
    return cut(E.top(R.dense(t.questions, t.passages, k=10), ["q"], 10, tie="passage_id", rank="rank"))


@query
def entity_boost_rerank(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.boost(_ranked(t), t.passages, t.found, CFG)


@query
def hyperedge_context(spark, sf_dir):
    return R.context(Tables(spark, sf_dir).found, CFG)


@query
def activation_one_hop(spark, sf_dir):
    t = Tables(spark, sf_dir)
    one = t.seed_scores.where("pos = 1")
    active, weights = R.activate_near(one, t.sentence_lists, t.asked, CFG)
    out = active.join(weights, ["q", "entity"], "full")
    return out.select("q", "entity", F.round(F.col("score") + HALF, 6).alias("score"), "tier", F.round(F.col("weight") + HALF, 6).alias("weight"))


@query
def activation_all_seeds(spark, sf_dir):
    active, weights = Tables(spark, sf_dir).activated
    return active.join(weights, ["q", "entity"], "full").select("q", "entity", F.round(F.col("score") + HALF, 6).alias("score"), "tier", F.round(F.col("weight") + HALF, 6).alias("weight"))


@query
def passage_scores(spark, sf_dir):
    return Tables(spark, sf_dir, 20).scored


def _top_ten(pr: DataFrame) -> DataFrame:
    return E.top(pr, ["q"], 10, tie="passage_id", rank="rank")


@query
def ppr_passages(spark, sf_dir):
    """Graph search: spreading activation, passage weights, PageRank."""
    t = Tables(spark, sf_dir, 20)
    return _top_ten(R.graph_search(t.activated[1], t.scored, t.nodes, t.edges, CFG, k=10, links=t.links))


@query
def ppr_unified(spark, sf_dir):
    """As ppr_passages, on the graph merged with the hypergraph."""
    t = Tables(spark, sf_dir, 20)
    edges = cut(H.merge_with_graph(t.edges, t.hyperedges, H.incidence(t.hyperedges), t.passage_hyperedges, by_text=True))
    reset = t.activated[1].select("q", node_id("entity", F.col("entity")).alias("id"), F.col("weight").alias("w"))
    reset = reset.unionByName(t.scored.select("q", F.col("passage_id").alias("id"), F.col("score").alias("w")))
    reset = reset.unionByName(t.found.select("q", F.concat(F.lit("hyperedge-"), "he_id").alias("id"), (F.col("score") * CFG.hyperedge_node_weight).alias("w")))
    pr = G.pagerank(H.merge_nodes(t.nodes, t.hyperedges), edges, reset, CFG.damping, kind="passage", k=10)
    return _top_ten(pr.select("q", F.col("id").alias("passage_id"), F.round("score", 6).alias("score")))


def _rows(results: DataFrame) -> DataFrame:
    """One row for each question and ranked passage."""
    both = F.arrays_zip("sorted_passage", "sorted_passage_scores")
    r = results.select("q", "has_entities", "has_hyperedge_context", F.posexplode(both).alias("pos", "x"))
    return r.select("q", (F.col("pos") + 1).alias("rank"), F.col("x.sorted_passage").alias("passage"), F.col("x.sorted_passage_scores").alias("score"), "has_entities", "has_hyperedge_context")


@query
def hybrid_retrieval(spark, sf_dir):
    t = Tables(spark, sf_dir, 20)
    return _rows(R.retrieve(t.questions, t.index(), "hybrid", CFG))


@query
def graph_retrieval(spark, sf_dir):
    t = Tables(spark, sf_dir, 20)
    return _rows(R.retrieve(t.questions, t.index(), "graph", CFG))


@query
def dense_retrieval(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return _rows(R.retrieve(t.questions, {"passages": t.passages}, "dense", CFG))


@query
def clinical_rerank(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return R.clinical_rerank(t.questions, _ranked(t), t.passages)


@query
def query_expansion(spark, sf_dir):
    d = _notes(Tables(spark, sf_dir))
    return d.select("doc_id", T.expand_query(F.col("text")).alias("expanded"))


def _assistant(t: Tables) -> DataFrame:
    return t.read("conversations").where("role = 'assistant' and text is not null")


@query
def answer_parse_mcq(spark, sf_dir):
    return _assistant(Tables(spark, sf_dir)).select("conv_id", "turn", T.parse_choice(F.col("text")).alias("pred"))


@query
def answer_parse_yesno(spark, sf_dir):
    c = F.col("text")
    return _assistant(Tables(spark, sf_dir)).select("conv_id", "turn", T.parse_words(c, "yes", "no").alias("yesno"), T.parse_words(c, "yes", "no", "maybe").alias("yesnomaybe"))


@query
def normalize_answer(spark, sf_dir):
    d = Tables(spark, sf_dir).read("documents")
    return d.select("doc_id", T.normalize_answer(F.col("text")).alias("normalized"))


def _results(t: Tables) -> DataFrame:
    k = F.col("conv_id") % 3
    sets = F.get(F.array(*map(F.lit, ("medqa", "pubmedqa", "bioasq"))), k.cast("int"))
    gold = F.get(F.array(*map(F.lit, ("A", "yes", "no"))), k.cast("int"))
    a = _assistant(t).select((F.col("conv_id") * 1000 + F.col("turn")).alias("idx"), F.col("text").alias("question"), sets.alias("dataset"), gold.alias("answer"), F.array("text").alias("sorted_passage"), (F.col("turn") % 4 == 1).alias("has_entities"))
    return a.withColumn("pred_answer", T.parse_answer(F.col("question"), F.col("dataset")))


@query
def contain_accuracy(spark, sf_dir):
    return A.judged(_results(Tables(spark, sf_dir))).select("idx", "correct", "invalid", "contain_correct", "no_entity")


@query
def summary_by_dataset(spark, sf_dir):
    return A.summarize(_results(Tables(spark, sf_dir)))


@query
def invalid_samples(spark, sf_dir):
    return A.invalid_samples(_results(Tables(spark, sf_dir)))


@query
def answer_distribution(spark, sf_dir):
    return A.distribution(_results(Tables(spark, sf_dir)), "pred_answer")


@query
def question_answering(spark, sf_dir):
    t = Tables(spark, sf_dir)
    r = A.answer(_results(t).drop("pred_answer"))
    return r.groupBy("dataset", "pred_answer").agg(F.count(F.lit(1)).alias("n"))


@query
def running_accuracy(spark, sf_dir):
    j = A.judged(_results(Tables(spark, sf_dir)))
    return A.running_mean(j, "correct", "idx", "dataset").select("idx", "dataset", "running")


@query
def gold_found(spark, sf_dir):
    t = Tables(spark, sf_dir)
    return A.gold_found(t.read("benchmark"), t.read("documents"))


@query
def dataset_counts(spark, sf_dir):
    return Tables(spark, sf_dir).read("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.when(F.coalesce(F.trim("text"), F.lit("")) != "", 1).otherwise(0)).cast("long").alias("with_text"), F.round(F.avg(F.length("text")), 6).alias("avg_chars"))


@query
def label_accuracy(spark, sf_dir):
    t = Tables(spark, sf_dir)
    j = t.read("labels").join(t.read("documents").select("doc_id", "source"), "doc_id")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("total"), F.sum("quality").cast("long").alias("good"), F.round(100 * T.ratio(F.sum("quality"), F.count(F.lit(1))), 6).alias("pct"))


@query
def json_props(spark, sf_dir):
    e = Tables(spark, sf_dir).read("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return e.groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total_k"))


@query
def incremental_new_docs(spark, sf_dir):
    d = Tables(spark, sf_dir).read("documents")
    manifest = d.where("source <= 'src1'").where("text is not null").select(content_hash(F.col("text")).alias("doc_hash")).distinct()
    return I.new_documents(d.select("doc_id", "text"), manifest).select("doc_id", "doc_hash")


@query
def ner_merge_upsert(spark, sf_dir):
    d = Tables(spark, sf_dir).read("documents").where("text is not null")
    count = F.size(T.tokens(F.col("text"))).cast("long")
    old = d.where("source <= 'src1'").groupBy(content_hash(F.col("text")).alias("key")).agg(F.max(count).alias("n_entities"), F.lit("old").alias("origin"))
    new = d.where("source > 'src1'").groupBy(content_hash(F.col("text")).alias("key")).agg(F.max(count).alias("n_entities"), F.lit("new").alias("origin"))
    return X.merge(old, new, "key")


@query
def cache_hit_rate(spark, sf_dir):
    e = Tables(spark, sf_dir).read("events")
    seen = F.lag("event_id").over(Window.partitionBy("user_id").orderBy("event_id")).isNotNull()
    return I.hit_rate(e.select(seen.alias("hit")))
