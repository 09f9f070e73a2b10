"""Indexes: build, load, extend; retrieval on them in every mode."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import retrieve as R
from skein.plans import index as N

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    path = str(tmp_path_factory.mktemp("index"))
    return docs, path, N.build_index(spark, docs, f"{path}/whole")


def table(df):
    return sorted(map(str, df.collect()))


def test_extended_index_equals_a_whole_one(spark, built):
    docs, path, whole = built
    N.build_index(spark, docs.where("doc_id % 3 = 0"), f"{path}/part")
    grown = N.extend_index(spark, docs, f"{path}/part", f"{path}/grown")
    for name in N.TABLES:
        cols = [c for c in whole[name].columns if c != "v"]
        assert table(grown[name].select(*cols)) == table(whole[name].select(*cols)), name
    a, b = ({r.passage_id: r.v for r in x["passages"].collect()} for x in (whole, grown))
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k]) for k in a)
    assert set(N.load_index(spark, f"{path}/whole")) == set(N.TABLES)


def test_modes(spark, built):
    _, _, index = built
    q = spark.read.parquet(f"{DIR}/benchmark.parquet").select(F.col("item_id").alias("q"), "text").limit(3)
    q = q.unionByName(spark.createDataFrame([(10**6, "no seed is")], "q long, text string"))
    got = {m: {r.q: r for r in R.retrieve(q, index, m).collect()} for m in R.MODES}
    assert all(len(got[m]) == 4 for m in R.MODES)
    for m in R.MODES:
        assert all(len(r.sorted_passage) == 3 and sorted(r.sorted_passage_scores, reverse=True) == r.sorted_passage_scores for r in got[m].values())
    assert not any(r.has_hyperedge_context for r in got["graph"].values()) and any(r.has_hyperedge_context for r in got["hybrid"].values())
    # Without seeds a question is ranked by vectors in graph mode too.
    assert not got["graph"][10**6].has_entities and got["graph"][10**6].sorted_passage_scores == got["dense"][10**6].sorted_passage_scores
    with pytest.raises(ValueError):
        R.retrieve(q, index, "other")
    # With a pool as large as the corpus the presets agree.
    whole = {r.q: r.sorted_passage for r in R.retrieve(q.limit(1), index, "graph", R.PRESETS["baseline"]).collect()}
    assert whole == {k: got["graph"][k].sorted_passage for k in whole} and whole


def test_only_passages_that_may_rise_are_boosted(spark, built):
    _, _, index = built
    rng = np.random.default_rng(4)
    ids = [r.passage_id for r in index["passages"].select("passage_id").collect()]
    ranked = spark.createDataFrame([(1, p, float(s)) for p, s in zip(ids, np.round(rng.uniform(0.5, 1.0, len(ids)), 6))], "q long, passage_id string, score double")
    ranked = R.encode.top(ranked, ["q"], 10**6, tie="passage_id", rank="rank")
    found = index["hyperedges"].limit(30).select(F.lit(1).cast("long").alias("q"), "entities")
    best = lambda r: table(R.boost(r, index["passages"], found).where("rank <= 3"))
    few = R.may_rise(ranked)
    assert best(few) == best(ranked) and few.count() < ranked.count()


def test_cached_hypergraph(spark, built, tmp_path):
    _, _, index = built
    one = N.cached_hypergraph(spark, index["sentence_entities"], str(tmp_path / "h"))
    two = N.cached_hypergraph(spark, index["sentence_entities"].limit(0), str(tmp_path / "h"))
    assert one["hyperedges"].count() == two["hyperedges"].count() > 0
