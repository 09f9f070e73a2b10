"""Steps that must not grow faster than their input, held against the plain way on small data."""

import os
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from skein.operators import corpus as C
from skein.operators import encode as E
from skein.operators import graph as G
from skein.operators import hypergraph as H
from skein.operators import retrieve as R
from skein.plans.catalog import Tables
from skein.sources.store import cut, discard

DIR = "/root/testdata/sf0.001"


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_entities_of_texts_by_hashes_and_by_joins(spark):
    texts = spark.createDataFrame([("Alpha gamma alpha",), ("delta gammas",), ("",), ("none at all",)], "text string")
    lex = spark.createDataFrame([("alpha",), ("gamma",), ("delta",)], "entity string")
    for limit in (100, 0):
        got = {r.text: sorted(r.entities) for r in C.with_entities(texts, lex, limit=limit).collect()}
        assert got == {"Alpha gamma alpha": ["alpha", "gamma"], "delta gammas": ["delta"], "": [], "none at all": []}


def test_counting_reads_a_text_once():
    text = "banana bananas anana Banana " + "x" * 60 + "banana " + "ananananana"
    entities = ["banana", "anana", "bananas", "lung cancer", "x", "", "zzzzz"]
    assert C.count_in(text, entities, {}) == [text.count(e) if e else 0 for e in entities]
    letters = "abcdefghij"
    words = [a + b + c + d + "word" for a in letters for b in letters for c in letters for d in letters]
    t = time.time()
    assert set(C.count_in(" ".join(words), words, {})) == {1}
    assert time.time() - t < 5  # 10,000 entities in a text of 90,000 characters


def test_sentences_are_dealt_without_their_tokens(spark):
    t = Tables(spark, DIR)
    plan = C.sentence_lists(t.sentences, t.lexicon)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Expand" not in plan
    plan = t.passage_hyperedges._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    want = H.passage_hyperedges(t.hyperedges, t.sentences)
    assert rows(t.passage_hyperedges, "passage_id", "he_id") == rows(want, "passage_id", "he_id")
    assert "Exchange" not in t.entity_edges._jdf.queryExecution().executedPlan().toString()


def test_written_tables_leave_no_shuffle_behind(spark):
    df = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert df.count() == 7 and os.listdir(df._stored.removeprefix("file:"))
    discard(df)
    assert not os.path.exists(df._stored.removeprefix("file:"))


def test_component_sizes(spark):
    p = spark.createDataFrame([(f"passage-{i}",) for i in range(6)], "passage_id string")
    ph = spark.createDataFrame([("passage-0", "a"), ("passage-1", "a"), ("passage-1", "b"), ("passage-2", "b"), ("passage-3", "c")], "passage_id string, he_id string")
    assert rows(H.component_sizes(p, ph), "n_nodes", "first") == [(1, "passage-4"), (1, "passage-5"), (2, "hyperedge-c"), (5, "hyperedge-a")]
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert rows(G.labels(chain), "node", "label") == [(i, 0) for i in range(41)] + [(100, 100), (101, 100)]


def test_products_come_in_slices(monkeypatch):
    monkeypatch.setattr(E, "SLICE_VALUES", 100)
    rng = np.random.default_rng(2)
    v, m = rng.normal(size=(30, 4)), rng.normal(size=(40, 4))
    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(v.tolist())], names=["item", "v"])
    got = list(E._products(batch, m))
    assert max(s.size for _, s in got) <= 100 and np.array_equal(np.concatenate([i for i, _ in got]), range(30))
    assert np.allclose(np.concatenate([s for _, s in got]), np.round(v @ m.T, 6))
    best = E._Best(40, 3)
    for item, s in got:
        best.add(item, s)
    q, item, s = best.trim()
    whole = np.round(v @ m.T, 6) + 0.0
    want = {(j, i) for j in range(40) for i in sorted(range(30), key=lambda i: (-whole[i, j], i))[:3]}
    assert {*zip(q.tolist(), item.tolist())} == want


def test_ties_and_the_least(spark):
    items = spark.createDataFrame([(f"i{k:02d}", [1.0, 0.0] if k % 2 else [0.0, 1.0]) for k in range(40)], "item string, v array<double>").repartition(3)
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.5, 0.5])], "q long, v array<double>")
    got = rows(E.similarities(q, items, k=2, least=True), "q", "item", "score")
    assert got == [(1, "i01", 1.0), (1, "i03", 1.0), (1, "i38", 0.0), (2, "i00", 0.5), (2, "i01", 0.5), (2, "i39", 0.5)]
    norm = {(r.q, r.item): r.norm for r in E.scaled(q, items).collect()}
    assert len(norm) == 80 and norm[1, "i01"] == 1.0 and norm[1, "i00"] == 0.0 and norm[2, "i05"] == 1.0


@pytest.mark.parametrize("iterations", [2, 3, 4])
def test_activation_on_the_nearest_sentences(spark, iterations):
    rng = np.random.default_rng(5)
    words = [f"entity{chr(97 + i)}" for i in range(12)]
    texts = sorted({" ".join(rng.choice(words, rng.integers(2, 5), replace=False).tolist()) for _ in range(60)})
    lists = spark.createDataFrame([(t, sorted(t.split())) for t in texts], "sentence string, entities array<string>")
    seed = spark.createDataFrame([(q, e, 1.0 - q / 10, i + 1) for q in range(3) for i, e in enumerate(sorted(rng.choice(words, 4, replace=False).tolist()))], "q long, entity string, score double, pos int")
    questions = R.encoded(spark.createDataFrame([(q, " ".join(rng.choice(words, 4).tolist())) for q in range(3)], "q long, text string"))
    cfg = R.Config(max_iterations=iterations, top_k_sentence=2)
    asked = cut(questions.select("q", "v"))
    sims = R.sentence_sims(questions, lists.select("sentence"), cfg)
    want = R.activate(seed, lists.select("sentence", F.explode("entities").alias("entity")), sims, cfg)
    got = R.activate_near(seed, lists, asked, cfg)
    assert rows(got[0], "q", "entity", "score", "tier") == rows(want[0], "q", "entity", "score", "tier")
    assert rows(got[1], "q", "entity", "weight") == rows(want[1], "q", "entity", "weight") and got[1].count() > 12


def test_expansion_reads_a_text_once(spark):
    from skein.functions import text as T

    df = spark.createDataFrame([("Pain, mi and COPD; pain",), ("painful",), (None,)], "text string").select(T.expand_query(F.col("text")).alias("x"))
    assert [r.x for r in df.collect()] == ["Pain, mi and COPD; pain " + " ".join(T.EXPANSIONS[t] for t in ("mi", "copd", "pain")), "painful", ""]
    assert df._jdf.queryExecution().optimizedPlan().toString().lower().count("rlike") == 0


@pytest.mark.parametrize("values", [G.ROUND_VALUES, 20])
def test_rank_on_links_equals_pagerank(spark, values):
    rng = np.random.default_rng(6)
    words = [f"word{chr(97 + i)}" for i in range(10)]
    data = [(f"passage-{i}", es, [1.0 / max(1, len(es))] * len(es)) for i in range(15) for es in [sorted(rng.choice(words, int(rng.integers(0, 5)), replace=False).tolist())]]
    links = cut(spark.createDataFrame(data, "passage_id string, entities array<string>, weights array<double>"))
    edges = C.edges(C.link_edges(links))
    lex = spark.createDataFrame([(w,) for w in words + ["alone"]], "entity string")
    nodes = C.nodes(links.select("passage_id", F.lit("").alias("text")), lex)
    e = spark.createDataFrame([(1, "worda", 2.0), (1, "alone", 1.0), (2, "wordb", 1.0), (3, "wordc", -1.0)], "q long, entity string, w double")
    p = spark.createDataFrame([(1, "passage-3", 0.5), (1, "passage-4", 0.1), (3, "passage-5", 2.0)], "q long, passage_id string, w double")
    reset = e.select("q", R.node_id("entity", F.col("entity")).alias("id"), "w").unionByName(p.select("q", F.col("passage_id").alias("id"), "w"))
    for k in (None, 3):
        want = {(r.q, r.id): r.score for r in G.pagerank(nodes, edges, reset, kind="passage", k=k).collect()}
        got = {(r.q, r.passage_id): r.score for r in G.linked_rank(links, e, p, k=k, values=values).collect()}
        assert got == pytest.approx(want, abs=1e-10) and len(want) > 5
