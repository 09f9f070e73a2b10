import json
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from skein.operators import answer as A
from skein.operators import corpus as C
from skein.operators import encode as E
from skein.operators import evaluate as V
from skein.operators import extract as X
from skein.operators import graph as G
from skein.operators import hypergraph as H
from skein.operators import incremental as I
from skein.operators import retrieve as R


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_edge_weights(spark):
    p = spark.createDataFrame([("p1", "aspirin helps. aspirin and fever. Fever")], "passage_id string, text string")
    pe = spark.createDataFrame([("p1", "aspirin"), ("p1", "fever"), ("p1", "other")], "passage_id string, entity string")
    got = {r.entity: (r.cnt, r.weight) for r in C.entity_edges(p, pe).collect()}
    assert got == {"aspirin": (2, pytest.approx(2 / 3)), "fever": (1, pytest.approx(1 / 3))}


def test_adjacency_is_numeric(spark):
    p = spark.createDataFrame([("x", "2:x"), ("y", "10:y"), ("z", "1:z"), ("n", "none")], "passage_id string, text string")
    assert rows(C.adjacent_edges(p), "src", "dst") == [("x", "y"), ("z", "x")]


def test_minmax(spark):
    d = spark.createDataFrame([(1, 2.0), (1, 2.0), (2, 1.0), (2, 3.0), (2, 2.0)], "q int, s double")
    got = sorted((r.q, r.m) for r in d.select("q", E.minmax(F.col("s"), ["q"]).alias("m")).collect())
    assert got == [(1, 1.0), (1, 1.0), (2, 0.0), (2, 0.5), (2, 1.0)]


def test_similarities_match_numpy(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(50, 8)).tolist()
    items = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "item long, v array<double>").repartition(5)
    q = spark.createDataFrame([(i, v[i]) for i in range(3)], "q long, v array<double>")
    got = {(r.q, r.item): r.score for r in E.similarities(q, items, k=4).collect()}
    want = {}
    for i in range(3):
        s = np.round(np.array(v) @ np.array(v[i]), 6)
        for j in sorted(range(50), key=lambda j: (-s[j], j))[:4]:
            want[i, j] = s[j]
    assert got == pytest.approx(want)


def test_hyperedges(spark):
    s2 = "a sentence of two entities"
    s4 = "a sentence that has four entities"
    data = [(s2, e) for e in ("a1", "b1")] + [(s4, e) for e in ("a1", "b1", "c1", "d1")] + [("nineteen characters"[:19], e) for e in ("a1", "b1")] + [("eleven entities in one sentence", f"e{i}") for i in range(11)]
    h = H.build(spark.createDataFrame(data, "sentence string, entity string"))
    assert rows(h, "sentence", "score") == [(s2, 0.5), (s4, 1.0)]


def test_type_inference_and_boost(spark):
    h = spark.createDataFrame([("x", "s", ["lung cancer", "azithromycin"], 2, 1.0)], "he_id string, sentence string, entities array<string>, n_entities int, score double")
    lit = H.enhance(h, "literal").first()
    inf = H.enhance(h, "inferred").first()
    assert (lit.boost, lit.score) == (1.0, 1.0)
    assert (inf.types, inf.boost, inf.score) == (["CHEMICAL", "DISEASE"], 1.3, 1.3)


def seeds(spark, data):
    return spark.createDataFrame(data, "q long, entity string, score double, pos int")


def test_activation_one_hop(spark):
    se = spark.createDataFrame([("S", "E1"), ("S", "E2")], "sentence string, entity string")
    for sim, weights, tiers in ((0.5, {"E1": 1.2, "E2": 0.4}, {"E1": (0.4, 2), "E2": (0.4, 2)}), (0.24, {"E1": 0.8}, {"E1": (0.8, 1)}), (0.3, {"E1": 0.8}, {"E1": (0.8, 1)})):
        sims = spark.createDataFrame([(1, "S", sim)], "q long, sentence string, sim double")
        a, w = R.activate(seeds(spark, [(1, "E1", 0.8, 1)]), se, sims)
        assert {r.entity: pytest.approx(r.weight) for r in w.collect()} == weights
        assert {r.entity: (pytest.approx(r.score), r.tier) for r in a.collect()} == tiers


def test_activation_claims_in_seed_order(spark):
    se = spark.createDataFrame([("S", "A"), ("S", "B")], "sentence string, entity string")
    sims = spark.createDataFrame([(1, "S", 0.9)], "q long, sentence string, sim double")
    _, w = R.activate(seeds(spark, [(1, "A", 1.0, 1), (1, "B", 0.5, 2)]), se, sims)
    assert {r.entity: pytest.approx(r.weight) for r in w.collect()} == {"A": 1.9, "B": 1.4}


def test_activation_tier_decay(spark):
    se = spark.createDataFrame([("S", "A"), ("S", "B"), ("T", "B"), ("T", "C")], "sentence string, entity string")
    sims = spark.createDataFrame([(1, "S", 1.0), (1, "T", 1.0)], "q long, sentence string, sim double")
    a, w = R.activate(seeds(spark, [(1, "A", 1.0, 1)]), se, sims, R.Config(max_iterations=3))
    got = {r.entity: (pytest.approx(r.score), r.tier) for r in a.collect()}
    assert got["C"] == (0.7, 3)


def test_passage_score(spark):
    dense = spark.createDataFrame([(1, "p1", 1.0), (1, "p2", 0.0)], "q long, passage_id string, score double")
    p = spark.createDataFrame([("p1", "Fever fever FEVER"), ("p2", "none")], "passage_id string, text string")
    act = spark.createDataFrame([(1, "fever", 0.5, 1)], "q long, entity string, score double, tier int")
    got = dict(rows(R.passage_scores(dense, p, act), "passage_id", "score"))
    assert got == {"p1": pytest.approx(0.7 + np.log(1 + 0.5 * np.log(4)), abs=1e-6), "p2": 0.0}


def test_boost(spark):
    ranked = spark.createDataFrame([(1, f"p{i}", 1.0, i + 1) for i in range(4)], "q long, passage_id string, score double, rank int")
    p = spark.createDataFrame([("p0", ""), ("p1", "aa"), ("p2", "aa bb cc dd"), ("p3", "AA bb")], "passage_id string, text string")
    found = spark.createDataFrame([(1, ["aa", "bb", "cc", "dd"])], "q long, entities array<string>")
    got = {r.passage_id: (r.matches, r.score, r["rank"]) for r in R.boost(ranked, p, found).collect()}
    assert got == {"p2": (4, 1.2, 1), "p3": (2, pytest.approx(1.133333), 2), "p1": (1, pytest.approx(1.066667), 3), "p0": (0, 1.0, 4)}


def graph_of(spark):
    rng = np.random.default_rng(3)
    n = 12
    nodes = spark.createDataFrame([(f"passage-{i:02d}",) for i in range(n)], "id string")
    e = sorted({tuple(sorted(rng.choice(n, 2, replace=False).tolist())) for _ in range(18)})
    edges = spark.createDataFrame([(f"passage-{a:02d}", f"passage-{b:02d}", float(1 + (a * b) % 3)) for a, b in e], "src string, dst string, weight double")
    return n, nodes, e, edges


@pytest.mark.parametrize("task_bytes", [G.TASK_BYTES, 0])
def test_pagerank(spark, task_bytes):
    n, nodes, e, edges = graph_of(spark)
    reset = spark.createDataFrame([(1, "passage-00", 3.0), (1, "passage-01", 1.0), (1, "passage-02", -5.0), (2, "passage-05", float("nan")), (2, "passage-06", 2.0)], "q int, id string, w double")
    got = {(r.q, r.id): r.score for r in G.pagerank(nodes, edges, reset, tolerance=1e-9 if task_bytes == 0 else G.TOLERANCE, task_bytes=task_bytes).collect()}
    m = np.zeros((n, n))
    for a, b in e:
        m[a, b] += 1 + (a * b) % 3
        m[b, a] += 1 + (a * b) % 3
    m /= np.maximum(m.sum(1, keepdims=True), 1e-300)
    for q, r in ((1, {0: 0.75, 1: 0.25}), (2, {6: 1.0})):
        start = np.zeros(n)
        for k, x in r.items():
            start[k] = x
        v = np.linalg.solve(np.eye(n) - 0.85 * m.T, 0.15 * start)
        v /= v.sum()
        for i in range(n):
            assert got.get((q, f"passage-{i:02d}"), 0) == pytest.approx(v[i], abs=1e-8)
        best = sorted(round(x, 6) for x in v)[-3]
        few = G.pagerank(nodes.withColumn("kind", F.lit("passage")), edges, reset, kind="passage", k=3, slack=1.2, task_bytes=task_bytes, tolerance=1e-9).where(F.col("q") == q).collect()
        assert {r.id for r in few} == {f"passage-{i:02d}" for i in range(n) if round(v[i], 6) * 1.2 >= best - 1e-12}
        assert sum(x for (k, _), x in got.items() if k == q) == pytest.approx(1)


def test_components_and_degrees(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    edges = spark.createDataFrame([("b", "a", 1.0), ("c", "b", 1.0), ("e", "d", 1.0), ("f", "e", 1.0)], "src string, dst string, weight double")
    assert dict(rows(G.components(nodes, edges), "id", "component")) == dict(a="a", b="a", c="a", d="d", e="d", f="d", g="g")
    assert dict(rows(G.degree_distribution(nodes, edges), "degree", "n_nodes")) == {0: 1, 1: 4, 2: 2}


def test_upper_median(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, 3, 10)], "v double")
    assert G.weight_stats(d, "v").first().median_value == 3.0


def test_bio_decode(spark):
    text = "acute lung cancer of left lung"
    t = [(1, 0, 0, 0, "O", 1.0), (1, 1, 0, 5, "B-D", 0.9), (1, 2, 6, 10, "I-D", 0.7), (1, 3, 11, 17, "I-D", 0.8), (1, 4, 18, 20, "O", 0.9), (1, 5, 21, 25, "I-D", 0.9), (1, 6, 26, 30, "B-A", 0.6)]
    tokens = spark.createDataFrame(t, "doc int, pos int, start int, stop int, label string, prob double")
    got = rows(X.bio_decode(tokens, spark.createDataFrame([(1, text)], "doc int, text string")), "text", "type", "score")
    assert got == [("acute lung cancer", "D", 0.8), ("lung", "A", 0.6)]


def results(spark):
    s = "idx int, question string, answer string, dataset string, sorted_passage array<string>, has_entities boolean, pred_answer string"
    return spark.createDataFrame([(0, "Q?\nA. x\nB. fever", "B", "MedQA", ["had Fever"], True, "b"), (1, "Q?", "yes", "pubmedqa", ["no"], False, "INVALID"), (2, "Q?", "no", "bioasq", None, True, "No")], s)


def test_summary(spark):
    got = {r.dataset: r for r in A.summarize(results(spark)).collect()}
    assert (got["medqa"].correct, got["medqa"].contain_correct, got["medqa"].invalid) == (1, 1, 0)
    assert (got["pubmedqa"].invalid, got["pubmedqa"].correct, got["pubmedqa"].no_entity) == (1, 0, 1)
    assert (got["ALL"].total, got["ALL"].correct) == (3, 2)
    assert [r.idx for r in A.invalid_samples(results(spark)).collect()] == [1]


def test_failing_reader(spark):
    def broken(system, user):
        raise OSError("no network")

    got = {r.idx: r.pred_answer for r in A.answer(results(spark).drop("pred_answer"), broken).collect()}
    assert got == {0: "C", 1: "INVALID", 2: "INVALID"}


def test_incremental(spark, tmp_path):
    d = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, None)], "doc_id int, text string")
    m = I.mark_indexed(spark.createDataFrame([], "doc_hash string, indexed_at timestamp"), I.new_documents(d.where("doc_id = 1"), spark.createDataFrame([], "doc_hash string")))
    assert rows(I.new_documents(d, m), "doc_id") == [(2,), (3,)]
    assert I.needs_rebuild(m, 2) and not I.needs_rebuild(m, 1)
    c = I.Cache(spark, str(tmp_path / "c"), "key string, value string")
    keys = spark.createDataFrame([("k",), ("z",)], "key string")
    assert rows(c.exists(keys), "key", "hit") == [("k", False), ("z", False)]
    c.set(spark.createDataFrame([("k", "1")], "key string, value string"))
    c.set(spark.createDataFrame([("k", "2")], "key string, value string"))
    assert rows(c.get(keys), "key", "value") == [("k", "2"), ("z", None)]
    c.clear()
    assert rows(c.exists(keys), "key", "hit") == [("k", False), ("z", False)]


def test_running_sums(spark):
    rng = np.random.default_rng(8)
    data = [(int(g), int(i), float(x)) for i, (g, x) in enumerate(zip(rng.integers(0, 3, 200), rng.integers(0, 9, 200)))]
    df = spark.createDataFrame(data, "g int, i int, x double").repartition(5)
    got = {r.i: (r.running, r.g) for r in A.running_mean(df, "x", "i", "g").collect()}
    for g, i, x in data:
        own = [y for h, j, y in data if h == g and j <= i]
        assert got[i] == (pytest.approx(sum(own) / len(own), abs=1e-6), g)
    whole = {r.i: r.running for r in A.running_mean(df, "x", "i").collect()}
    assert whole[199] == pytest.approx(sum(x for _, _, x in data) / 200, abs=1e-6)


def test_gold_found(spark):
    texts = ["the start " + "x" * 200 + " end", "short", "", None, "abcdefghijklmnopqrstuvwxyz0123456789" * 5]
    items = ["x" * 150, "hor", "long text with short inside of it, and more", None, "nothing of these in here at all, really none", "x abcdefghijklmnopqrstuvwxyz0123456789" + "abcdefghijklmnopqrstuvwxyz0123456789" * 4]
    t = spark.createDataFrame([(x,) for x in texts], "text string")
    i = spark.createDataFrame(list(enumerate(items)), "item_id int, text string")
    want = {k: any(t and x is not None and (x[:100] in t or t[:100] in x) for t in texts) for k, x in enumerate(items)}
    assert {r.item_id: r.found for r in A.gold_found(i, t).collect()} == want
    assert {r.item_id: r.found for r in A.gold_found(i, t, block_bytes=100).collect()} == want and sum(want.values()) == 4


def test_evaluate(spark, tmp_path):
    data = [{"question": "q", "pred_answer": " A ", "gold_answer": "a", "dataset": "medqa"}, {"question": "q", "pred_answer": "The heart.", "gold_answer": "heart", "dataset": "open"}, {"question": "q", "pred_answer": "", "gold_answer": "x", "dataset": "open"}, {"question": "q", "pred_answer": "B", "gold_answer": None, "dataset": "medqa"}]
    (tmp_path / "p.json").write_text(json.dumps(data))
    p = V.predictions(spark, str(tmp_path / "p.json"))
    got = {r.idx: (r.llm_accuracy, r.contain_accuracy) for r in V.evaluate(p).collect()}
    assert got == {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (0.0, 0.0), 3: (0.0, 0.0)}  # as an article `a` is left out, and nothing is in everything

    def broken(system, user):
        raise OSError("no network")

    assert {r.idx: r.llm_accuracy for r in V.evaluate(p, broken).collect()} == {0: 1.0, 1: 0.0, 2: 0.0, 3: 0.0}
    V.write_evaluation(V.evaluate(p), str(tmp_path / "out"))
    one = spark.read.json(str(tmp_path / "out/evaluation_results")).first()
    assert (one.llm_accuracy, one.contain_accuracy) == (0.5, 0.5)
    assert V.aggregate(V.evaluate(p.limit(0))).first().llm_accuracy == 0
    r = spark.createDataFrame([("Yes", "yes "), ("No", None)], "raw string, parsed string")
    assert V.mismatches(r, "raw", "parsed").count() == 1


def test_reports(spark):
    q = spark.createDataFrame([("the patient has an infection",), ("rational choice",), ("what is it",)], "text string")
    assert {r.bucket: r.n for r in V.topic_buckets(q).collect()} == {"medical": 1, "general": 1, "other": 1}
    c = spark.createDataFrame([("P<0.05 was found",), ("nothing here",)], "text string")
    assert [(r.has_numbers, r.has_stats, r.has_results) for r in V.presence_flags(c).collect()] == [(True, True, True), (False, False, False)]
    log = "Retrieving:  10%|#  | 10/100 [01:00<09:00]\rRetrieving:  50%|##| 50/100 [1:40:00<1:00]\nEntity embeddings: (123, 768) Passage embeddings: (45, 768)"
    logs = spark.createDataFrame([("a", log), ("b", "none")], "log string, text string")
    got = {r.log: r for r in V.progress(logs).collect()}
    assert (got["a"].percent, got["a"].done, got["a"].elapsed, got["a"].per_question, got["a"].left) == (50, 50, 6000, 120.0, 6000.0)
    assert got["b"].done is None
    sizes = {r.log: r for r in V.graph_sizes(logs).collect()}
    assert (sizes["a"].entities, sizes["a"].passages, sizes["a"].sentences) == (123, 45, None)
    f = spark.createDataFrame([(1, "Q\nA. x"), (2, "Options: y"), (3, "none")], "i int, question string")
    assert V.has_options(f, "i", 2).first()[0] and not V.has_options(f, "i").first()[0]
    assert V.timed({"x": lambda: 5})["x"][0] == 5


def test_model_extractors(spark):
    texts = spark.createDataFrame([(1, "acute lung cancer"), (2, "fails"), (3, None), (4, "")], "doc int, text string")

    def model(batch):
        if "fails" in batch:
            raise MemoryError
        out = []
        for t in batch:
            at = [m.span() for m in re.finditer(r"\S+", t)]
            out.append((at, [[5.0, 0.0, 0.0] if t[a:b] == "acute" else [0.0, 5.0, 0.0] if t[a:b] == "lung" else [0.0, 0.0, 5.0] for a, b in at]))
        return out

    tokens = X.classified(texts, model, ["O", "B-D", "I-D"])
    got = rows(X.bio_decode(tokens, texts), "doc", "text", "type", "score")
    assert got == [(1, "lung cancer", "D", pytest.approx(np.exp(5) / (np.exp(5) + 2), abs=1e-6))]
    e = spark.createDataFrame([(1, " Lung##s ", "D"), (1, "ab", "D"), (2, "\u0120heart", "A"), (2, "\u2581brain", None)], "id int, word string, entity_group string")
    m = X.model_entities(e)
    assert rows(m, "id", "text") == [(1, "lungs"), (2, "heart")]
    t = spark.createDataFrame([(1, "x"), (2, "x"), (3, "pain and fever")], "id int, text string")
    more = spark.createDataFrame([(1, "asthma")], "id int, text string")
    assert {r.id: r.entities for r in X.union_entities(t, m, more).collect()} == {1: ["asthma", "lungs"], 2: ["heart"], 3: ["fever", "pain"]}
    c = spark.createDataFrame([(1, "The Amino Acid of genes; cellular")], "id int, text string")
    assert rows(X.category_terms(c), "category", "term") == [("genetics", "genes"), ("molecules", "amino acid")]
    assert X.categories(spark).count() == sum(map(len, X.CATEGORIES.values()))
    found = spark.createDataFrame([("DISEASE", "asthma"), ("DISEASE", "flu")], "type string, text string")
    assert [(r.type, r.n, r.examples) for r in X.type_counts(found).collect()] == [("DISEASE", 2, ["asthma", "flu"])]
    keep = spark.createDataFrame([("CHEMICAL", " Aspirin"), ("GENE", "brca"), ("DISEASE", "flu"), ("DISEASE", "ms")], "label string, text string")
    assert rows(X.keep_entities(keep), "text") == [("aspirin",), ("flu",)]


def test_incremental_writes(spark):
    store = spark.createDataFrame([("passage-1", "old", [0.0])], "hash_id string, text string, embedding array<double>")
    new = I.insert_texts(store, spark.createDataFrame([("old",), ("new",), ("new",)], "text string"), E.hashed("word"), "passage")
    assert rows(new, "text") == [("new",), ("old",)]
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id int, text string")
    seen, m = I.process_batches(docs, spark.createDataFrame([], "doc_hash string, indexed_at timestamp"), lambda d: d.count())
    assert (seen, I.manifest_stats(m).first().n_docs, I.clear(m).count()) == (2, 2, 0)
    again, _ = I.process_batches(docs, m, lambda d: d.count())
    assert again == 0


def test_hypergraph_lookups(spark):
    h = H.build(spark.createDataFrame([("a sentence of two entities", e) for e in ("a1", "b1")], "sentence string, entity string"))
    inc = H.incidence(h)
    he = h.first().he_id
    ids = spark.createDataFrame([(he,), ("none",)], "he_id string")
    assert {r.he_id: r.score for r in H.lookup(h, ids).collect()} == {he: 1.0, "none": 0.0}
    assert H.entities_of(inc, ids).count() == 2 and H.hyperedges_of(inc, inc.limit(1)).count() == 1
    assert H.bipartite_edges(h, inc).count() == 2
    p = spark.createDataFrame([("p", "x a sentence of two entities y"), ("r", "no")], "passage_id string, text string")
    assert rows(H.passage_hyperedges_exact(h, p), "passage_id", "he_id") == [("p", he)]


def test_logs_and_speedups(spark):
    logs = spark.createDataFrame([("a", "took 4.0s took 2.0s"), ("b", "took 1.0s")], "log string, text string")
    means = A.timing_means(logs, r"took ([\d.]+)s", 1)
    assert {r.log: r.speedup for r in A.speedups(means, "log").collect()} == {"a": 1.0, "b": 2.0}
    d = spark.createDataFrame([("x", i) for i in range(5)], "k string, i int")
    assert rows(A.first_examples(d, "k", "i", 2), "i") == [(0,), (1,)]
