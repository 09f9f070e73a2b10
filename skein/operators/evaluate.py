"""Evaluation of stored predictions, and reports over logs, contexts and question texts."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import norm, normalize_answer, ratio, strip
from skein.operators.answer import FAILED

cloudpickle.register_pickle_by_value(sys.modules[__name__])

PREDICTION = "idx long, question string, pred_answer string, gold_answer string, dataset string"
# Data sets whose answers are compared as strings, and the judge's prompt texts.
DIRECT = ["medqa", "medmcqa", "mmlu", "bioasq", "pubmedqa"]
JUDGE_SYSTEM = "You are an expert evaluator. "
JUDGE_USER = """Please evaluate if the generated answer is correct by comparing it with the gold answer.
Generated answer: {pred}
Gold answer: {gold}

The generated answer should be considered correct if it:
1. Contains the key information from the gold answer
2. Is factually accurate and consistent with the gold answer
3. Does not contain any contradicting information

Respond with ONLY 'correct' or 'incorrect'.
Response:
"""


def predictions(spark: SparkSession, path: str) -> DataFrame:
    """idx, question, pred_answer, gold_answer, dataset of a JSON array of predictions; idx is the place in the array."""
    item = ", ".join(PREDICTION.split(", ")[1:]).replace(" string", ":string")
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.posexplode(F.from_json("value", f"array<struct<{item}>>")).alias("idx", "p")).select(F.col("idx").cast("long").alias("idx"), "p.*")


def strict_judge(system: str, user: str) -> str:
    """Offline judge: correct if the gold answer's text stands in the generated one."""
    pred, _, gold = user.partition("Generated answer: ")[2].partition("\nGold answer: ")
    gold = gold.partition("\n\n")[0].strip().lower()
    return "correct" if gold and gold in pred.lower() else "incorrect"


def contain(pred: Column, gold: Column) -> Column:
    """1 if the normalised gold stands in the normalised prediction; 0 if either is empty."""
    filled = (norm(pred) != "") & (norm(gold) != "")
    return (filled & F.contains(normalize_answer(F.coalesce(pred, F.lit(""))), normalize_answer(F.coalesce(gold, F.lit(""))))).cast("int")


def evaluate(predicted: DataFrame, judge=strict_judge) -> DataFrame:
    """Adds llm_accuracy and contain_accuracy (0 or 1): answers of the known sets are compared as strings, others go to the judge, a plug-in called in the tasks; a failing call counts as incorrect."""
    known = F.coalesce(F.col("dataset").isin(*DIRECT), F.lit(False))
    same = F.lower(norm(F.col("pred_answer"))) == F.lower(norm(F.col("gold_answer")))
    direct = predicted.where(known).withColumn("llm_accuracy", same.cast("double"))

    def run(it):
        for pdf in it:
            said = []
            for pred, gold in zip(pdf["pred_answer"], pdf["gold_answer"]):
                try:
                    said.append(judge(JUDGE_SYSTEM, JUDGE_USER.format(pred=pred, gold=gold)))
                except Exception:  # a judge is outside code; its failure is an answer
                    said.append(FAILED)
            yield pdf.assign(llm_accuracy=[float(x.strip().lower() == "correct") for x in said])

    schema = predicted.schema.add("llm_accuracy", "double") if "llm_accuracy" not in predicted.columns else predicted.schema
    judged = predicted.where(~known).mapInPandas(run, schema)
    return direct.unionByName(judged).withColumn("contain_accuracy", contain(F.col("pred_answer"), F.col("gold_answer")).cast("double"))


def aggregate(evaluated: DataFrame) -> DataFrame:
    """One row: llm_accuracy and contain_accuracy over all predictions; 0 without any."""
    n = F.count(F.lit(1))
    return evaluated.agg(F.round(ratio(F.coalesce(F.sum("llm_accuracy"), F.lit(0.0)), n), 6).alias("llm_accuracy"), F.round(ratio(F.coalesce(F.sum("contain_accuracy"), F.lit(0.0)), n), 6).alias("contain_accuracy"))


def write_evaluation(evaluated: DataFrame, path: str) -> None:
    """Predictions with their metrics, and the aggregate, as JSON under a new path."""
    evaluated.write.mode("overwrite").json(f"{path}/predictions")
    aggregate(evaluated).write.mode("overwrite").json(f"{path}/evaluation_results")


def mismatches(results: DataFrame, raw: str, parsed: str) -> DataFrame:
    """Rows whose raw answer differs from the parsed one, white space and case aside."""
    return results.where(~F.lower(norm(F.col(raw))).eqNullSafe(F.lower(norm(F.col(parsed)))))


# Topic words of questions without entities.
BUCKETS = {
    "medical": ["patient", "clinical", "medical", "hospital", "catheter", "drug", "infection", "breathing", "pulse", "urinary"],
    "general": ["hardy", "weinberg", "rational", "choice", "evolution", "intracellular", "successional"],
}


def _any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def topic_buckets(questions: DataFrame) -> DataFrame:
    """bucket, n, pct of question texts: medical, general, and all minus both as other, so a text of both topics counts in each."""
    low = F.lower("text")
    t = questions.agg(*(F.coalesce(F.sum(_any(low, words).cast("long")), F.lit(0)).alias(k) for k, words in BUCKETS.items()), F.count(F.lit(1)).alias("total"))
    rows = F.array(*(F.struct(F.lit(k).alias("bucket"), F.col(k).alias("n")) for k in BUCKETS), F.struct(F.lit("other").alias("bucket"), (F.col("total") - F.col("medical") - F.col("general")).alias("n")))
    return t.select("total", F.explode(rows).alias("x")).select("x.bucket", "x.n", F.round(100 * ratio(F.col("x.n"), F.col("total")), 6).alias("pct"))


# Words that tell statistics and results.
STATISTICS = ["p<", "p=", "p>", "or=", "ci", "95%", "mean", "median"]
FINDINGS = ["results", "found", "showed", "demonstrated", "observed"]


def presence_flags(contexts: DataFrame) -> DataFrame:
    """Adds n_chars, has_numbers, has_stats and has_results of each text."""
    low = F.lower("text")
    return contexts.withColumns({"n_chars": F.length("text"), "has_numbers": F.col("text").rlike(r"\d"), "has_stats": _any(low, STATISTICS), "has_results": _any(low, FINDINGS)})


PROGRESS = r"Retrieving:\s+(\d+)%[^\n\r]*?(\d+)/(\d+)[^\n\r]*?\[([\d:]+)<"


def progress(logs: DataFrame) -> DataFrame:
    """log, percent, done, total, elapsed, seconds per question and seconds left, from the last progress mark of each log (log, text); null without one."""
    part = lambda i: F.element_at(F.regexp_extract_all("text", F.lit(PROGRESS), i), -1)
    found = F.size(F.regexp_extract_all("text", F.lit(PROGRESS), 1)) > 0
    t = logs.select("log", *(F.when(found, part(i)).alias(c) for i, c in ((1, "percent"), (2, "done"), (3, "total"), (4, "elapsed"))))
    seconds = F.aggregate(F.split("elapsed", ":"), F.lit(0).cast("long"), lambda s, x: s * 60 + x.cast("long"))
    done, total = F.col("done").cast("long"), F.col("total").cast("long")
    each = F.when(done > 0, seconds / done)
    return t.select("log", F.col("percent").cast("int").alias("percent"), done.alias("done"), total.alias("total"), seconds.alias("elapsed"), F.round(each, 6).alias("per_question"), F.round((total - done) * each, 6).alias("left"))


def graph_sizes(logs: DataFrame) -> DataFrame:
    """log, entities, passages, sentences that a log reports; null where it doesn't."""
    size = lambda kind: F.try_element_at(F.regexp_extract_all("text", F.lit(rf"{kind} embeddings: \((\d+),"), 1), F.lit(1)).cast("long")
    return logs.select("log", size("Entity").alias("entities"), size("Passage").alias("passages"), size("Sentence").alias("sentences"))


def has_options(questions: DataFrame, order: str, n: int = 10) -> DataFrame:
    """One row: whether the first n questions all show options."""
    shown = F.contains("question", F.lit("Options:")) | _any(F.col("question"), ["A.", "B.", "C.", "D."])
    return questions.orderBy(order).limit(n).agg(F.coalesce(F.every(shown), F.lit(True)).alias("has_options"))


def timed(steps: dict) -> dict:
    """name -> (result, seconds) of each callable, run in order."""
    import time

    out = {}
    for name, step in steps.items():
        began = time.perf_counter()
        out[name] = (step(), time.perf_counter() - began)
    return out
