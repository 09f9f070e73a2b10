import json
import subprocess
import sys
from datetime import datetime
from pathlib import Path

import pytest

from skein.sources import readers, store
from skein.streaming.ingest import ingest, windowed_counts


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_jsonl_corpus(spark, tmp_path):
    write(tmp_path / "b.jsonl", "\n".join([json.dumps({"contents": "third"}), json.dumps({"passage": "fourth"})]))
    write(tmp_path / "a.jsonl", "\n".join([json.dumps({"contents": " first "}), "", "{broken", json.dumps({"contents": "", "text": "second"}), json.dumps({"contents": "   ", "text": "good"})]))
    got = [r.text for r in readers.jsonl_corpus(spark, str(tmp_path)).orderBy("path", "line").collect()]
    assert got == ["first", "second", "third", "fourth"]
    assert [r.text for r in readers.jsonl_corpus(spark, str(tmp_path), 3).collect()] == ["first", "second", "third"]


def test_question_sets(spark, tmp_path):
    write(tmp_path / "medqa.jsonl", "\n".join(json.dumps(x) for x in [{"question": "Q1", "answer_idx": "B", "options": {"B": "b", "A": "a"}}, {"question": "Q2", "options": {}}]))
    write(tmp_path / "mcqa.jsonl", "\n".join(json.dumps({"question": "Q", "opa": "w", "opb": "x", "opc": "y", "opd": "z", "cop": c}) for c in (1, 4, 0, None)))
    write(tmp_path / "pub.json", json.dumps({"11": {"QUESTION": "P", "CONTEXTS": ["c1", "c2"], "LABELS": ["L"], "final_decision": "Maybe"}, "12": {"QUESTION": "P", "CONTEXTS": [], "final_decision": "what"}}))
    qs = [{"id": "1", "type": "yesno", "body": "Y?", "exact_answer": "yes"}, {"id": "2", "type": "yesno", "body": "Y?", "exact_answer": [["yes"]]}, {"id": "3", "type": "factoid", "body": "F", "exact_answer": "x"}, {"id": "4", "type": "summary", "body": "S"}]
    write(tmp_path / "bio/Task1BGoldenEnriched/x_golden.json", json.dumps({"questions": qs}))
    write(tmp_path / "mmlu/anatomy_test.csv", '"What, now?",a,b,c,d,b\n"two\nlines",a,b,c,d,C\nshort,a,b,c,d\n')
    paths = {"medqa": str(tmp_path / "medqa.jsonl"), "medmcqa": str(tmp_path / "mcqa.jsonl"), "pubmedqa": str(tmp_path / "pub.json"), "bioasq": str(tmp_path / "bio"), "mmlu": str(tmp_path / "mmlu")}
    got = readers.questions(spark, list(paths), paths).orderBy("set_pos", "line", "pos").collect()
    assert [(r.dataset, r.answer) for r in got] == [("medqa", "B"), ("medmcqa", "A"), ("medmcqa", "D"), ("medmcqa", "A"), ("medmcqa", "A"), ("pubmedqa", "maybe"), ("bioasq", "yes"), ("mmlu", "B"), ("mmlu", "C")]
    assert got[0].question == "Q1\nA. a\nB. b"
    with pytest.raises(ValueError):
        readers.questions(spark, ["other"], {})
    chunk = readers.context_chunks(spark, paths["pubmedqa"]).where("pmid = '11'").first()
    assert chunk.text == "c1 c2"


def test_bundle_and_graphml(spark, tmp_path):
    nodes = spark.createDataFrame([("a", 'x "<&>'), ("b", "y")], "id string, content string")
    edges = spark.createDataFrame([("a", "b", 0.5)], "src string, dst string, weight double")
    store.save_bundle({"nodes": nodes, "edges": edges}, str(tmp_path / "i"))
    assert store.load_bundle(spark, str(tmp_path / "i"), "edges")["edges"].first().weight == 0.5
    assert store.try_load_bundle(spark, str(tmp_path / "none"), "edges") is None
    store.write_graphml(nodes, edges, str(tmp_path / "g"))
    n, e = store.read_graphml(spark, str(tmp_path / "g"))
    assert sorted(map(tuple, n.collect())) == sorted(map(tuple, nodes.collect()))
    assert [tuple(r) for r in e.collect()] == [("a", "b", 0.5)]


def test_streaming_ingest(spark, tmp_path):
    for i, texts in enumerate((["a", "b"], ["b", "c"])):
        spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema("text string").parquet(str(tmp_path / "in/*"))
    q = ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_more_readers(spark, tmp_path):
    write(tmp_path / "first.jsonl", "\n".join(json.dumps({"text": x}) for x in ("p1", "p2")))
    write(tmp_path / "rest/pubmed23n1.jsonl", "\n".join(json.dumps({"contents": x}) for x in ("r1", "r2", "r3")))
    got = readers.prioritized_corpus(spark, str(tmp_path / "first.jsonl"), str(tmp_path / "rest"), 4)
    assert [r.text for r in got.collect()] == ["p1", "p2", "r1", "r2"]
    write(tmp_path / "chunks.json", json.dumps(["a", "b"]))
    assert [r.text for r in readers.standard_chunks(spark, str(tmp_path / "chunks.json")).collect()] == ["0:a", "1:b"]
    write(tmp_path / "q.json", json.dumps([{"question": "Q", "answer": "A"}]))
    assert [(r.idx, r.question, r.answer) for r in readers.standard_questions(spark, str(tmp_path / "q.json")).collect()] == [(0, "Q", "A")]
    write(tmp_path / "old.json", json.dumps([{"question": "Q", "options": {"B": "b", "A": "a"}, "answer_idx": "B"}]))
    old = readers.legacy_medqa(spark, str(tmp_path / "old.json")).first()
    assert (old.question, old.answer, old.answer_idx, old.metamap_phrases) == ("Q\nB. b\nA. a\n", "b", "B", [])
    assert {r.path.rsplit("/", 1)[1] for r in readers.inventory(spark, str(tmp_path / "rest")).collect()} == {"pubmed23n1.jsonl"}
    assert readers.inventory(spark, str(tmp_path / "none")).count() == 0


def test_abstracts(spark):
    a = spark.createDataFrame([("1", "T", "text"), ("2", None, " "), ("3", None, "more")], "pmid string, title string, abstract string")
    o = spark.createDataFrame([("1", "Q", "yes")], "pmid string, question string, answer string")
    got = {r.pmid: (r.text, r.answer) for r in readers.abstract_chunks(a, o).collect()}
    assert got == {"1": ("T\n\ntext", "yes"), "3": ("more", None)}
    c = readers.coverage(a).first()
    assert (c.total, c.with_abstract, c.avg_length, c.min_length, c.max_length) == (3, 2, 4.0, 4, 4)
    assert [r.pmid for r in readers.resume(a, o, "pmid").orderBy("pmid").collect()] == ["2", "3"]
    assert readers.concat_corpora(a, o).count() == 4
    s = spark.createDataFrame([({"AIM": "x"},)], "s map<string,string>")
    assert s.select(readers.section_text("s").alias("t")).first().t == "AIM: x"
    labels = spark.createDataFrame([(["A", "B"],), (["B"],)], "labels array<string>")
    assert [(r.label, r.n) for r in readers.label_counts(labels).collect()] == [("B", 2), ("A", 1)]
    ids = spark.createDataFrame([("12",), ("34",), ("56",), ("789",)], "pmid string")
    corpus = spark.createDataFrame([("12",), ("PubMed_34",), ("pmid_56",)], "key string")
    assert {r.pmid: r.found for r in readers.id_overlap(ids, corpus, "key").collect()} == {"12": True, "34": True, "56": False, "789": False}
    texts = spark.createDataFrame([("see 7890 and x56x",), (None,)], "text string")
    assert {r.pmid: r.found for r in readers.id_in_text(ids, texts).collect()} == {"12": False, "34": False, "56": True, "789": True}
    assert [r.pmid for r in readers.last_rows(a, "pmid", 2).collect()] == ["3", "2"]


def test_run_folders(spark, tmp_path):
    now = datetime(2024, 1, 2, 3, 4, 5)
    assert store.run_name("medqa", now=now) == "medqa_20240102_030405"
    assert store.run_name("x", ("a", "b"), True, now) == "x_mirage_a_b_20240102_030405"
    assert store.run_name("x", (), True, now) == "x_mirage_unknown_20240102_030405"
    one = spark.createDataFrame([("a", 1)], "k string, v int")
    store.write_run(one, one, str(tmp_path / "run"))
    assert spark.read.json(str(tmp_path / "run/summary")).first().k == "a"
    assert store.namespace("bioasq", ["default-medqa"]) == "default-medqa" and store.namespace("mmlu", []) == "default-mmlu"


def test_shared_dir_without_the_setting():
    """In a process of its own: the session here has the setting."""
    code = "from pyspark.sql import SparkSession; from skein.sources.store import cut; from skein.llm.shared import shared_dir; s = SparkSession.builder.master('{}').config('spark.ui.enabled', 'false').getOrCreate(); print(cut(s.range(3)).count(), shared_dir(s))"
    root = str(Path(__file__).resolve().parent.parent)
    code = code if (Path(root) / "skein/llm").exists() else code.replace("from skein.llm.shared", "from skein.sources.store")
    run = subprocess.run([sys.executable, "-c", code.format("local[1]")], cwd=root, capture_output=True, text=True)
    assert run.stdout.split()[-2] == "3", run.stderr[-2000:]


def test_windowed_counts(spark, tmp_path):
    rows = [("2024-01-01 00:00:10", "a", 1.0), ("2024-01-01 00:00:50", "a", 2.0), ("2024-01-01 00:01:10", "b", 4.0), ("2024-01-01 01:00:00", "a", 0.0)]
    spark.createDataFrame(rows, "t string, event_type string, value double").selectExpr("cast(t as timestamp) ts", "event_type", "value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = windowed_counts(stream, "1 minute", "5 minutes").writeStream.format("memory").queryName("windowed").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("windowed").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
