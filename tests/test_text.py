from pyspark.sql import functions as F

from skein.functions import text as T
from skein.functions.ids import hyperedge_id, node_id


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


def test_answer_parsing(spark):
    cases = {"b": "B", "The answer is B": "B", "Answer: C": "C", "This is a guess: D": "A", "Option D is correct": "D", "none": "INVALID", "Error: Could not get LLM response": "C"}
    for text, want in cases.items():
        assert one(spark, text, T.parse_choice) == want, text
    assert one(spark, "It is unlikely. No.", lambda c: T.parse_words(c, "yes", "no")) == "No"
    assert one(spark, "MAYBE!", lambda c: T.parse_words(c, "yes", "no", "maybe")) == "Maybe"
    assert one(spark, "Noted", lambda c: T.parse_words(c, "yes", "no")) == "INVALID"


def test_normalize_strip_truncate(spark):
    assert one(spark, "The  Heart-Attack, a test.", T.normalize_answer) == "heartattack test"
    assert one(spark, "\t  x\n", T.strip) == "x"
    assert one(spark, "abcdef", lambda c: T.truncate(c, 3)) == "abc..."
    assert one(spark, "Thought. Answer: B because", T.answer_letter) == "B"
    assert one(spark, "so A or C", T.answer_letter) == "C"


def test_occurrences(spark):
    text = "aspirin helps. aspirin and fever. Fever"
    assert one(spark, text, lambda c: T.occurrences(c, F.lit("aspirin"))) == 2
    assert one(spark, text, lambda c: T.occurrences(c, F.lit("fever"))) == 1
    assert one(spark, "aaaa", lambda c: T.occurrences(c, F.lit("aa"))) == 2


def test_extractors(spark):
    assert one(spark, "Fever and pain after aspirin; feverish", T.keyword_entities) == ["aspirin", "fever", "pain"]
    got = one(spark, "Amoxicillin for lymphoma, glucose level", T.typed_entities)
    assert {(r.text, r.type) for r in got} == {("Amoxicillin", "DRUG"), ("lymphoma", "DISEASE"), ("glucose level", "LAB")}
    assert one(spark, "What is the ATP of Heart cells at 5 mg?", T.dictionary_entities) == ["5 mg", "ATP", "Heart", "cells", "heart"]


def test_query_expansion(spark):
    assert one(spark, "pain in MI", T.expand_query) == "pain in MI myocardial infarction heart attack discomfort ache"


def test_clinical_factor(spark):
    q = "A 40-year-old patient presents with acute cough"
    row = spark.createDataFrame([(q, "the patient had an acute case report in 1975")], "q string, p string")
    got = row.select(T.clinical_factor(T.clinical_keywords(F.col("q")), F.col("p")).alias("f")).first()["f"]
    assert abs(got - (1 + 0.24 + 0.05 - 0.3 + 0.15)) < 1e-9


def test_ids(spark):
    import hashlib

    assert one(spark, "abc", lambda c: node_id("entity", c)) == "entity-" + hashlib.sha256(b"entity-abc").hexdigest()
    got = one(spark, "s", lambda c: hyperedge_id(c, F.array(F.lit("b"), F.lit("a"))))
    assert got == hashlib.md5(b"s|a|b").hexdigest()[:16]


def test_keyword_relevance(spark):
    row = spark.createDataFrame([("Which kidney disease? kidney", "The KIDNEY is an organ; " + "x" * 200 + "disease")], "q string, p string")
    assert row.select(T.keyword_relevance(F.col("q"), F.col("p")).alias("n")).first().n == 2
