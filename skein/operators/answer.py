"""Prompts, readers and summaries of question answering."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.functions.text import norm, normalize_answer, parse_answer, ratio, strip
from skein.operators.ordered import running_sums
from skein.sources.store import cut

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Prompt texts and the reader's failure text.
PROMPTS = {
    "pubmedqa": """\
You are a medical expert. Answer the question based on the provided context.

IMPORTANT: You MUST respond with EXACTLY one of these three words: Yes, No, or Maybe
Do NOT add any punctuation, explanation, or other text.

Example responses:
- Yes
- No  
- Maybe""",
    "bioasq": """\
You are a medical expert. Answer the yes/no question based on the provided context.

IMPORTANT: You MUST respond with EXACTLY one of these two words: Yes or No
Do NOT add any punctuation, explanation, or other text.

Example responses:
- Yes
- No""",
    "choice": """\
You are a medical expert. Answer the multiple-choice question based on the provided context.

CRITICAL INSTRUCTIONS:
1. You MUST respond with ONLY ONE LETTER: A, B, C, or D
2. Do NOT write "Answer: A" - just write "A"
3. Do NOT add any explanation, reasoning, or other text
4. Do NOT write "Thought:" or anything else

CORRECT examples:
- A
- B
- C
- D

INCORRECT examples (DO NOT DO THIS):
- Answer: A
- Thought: ... Answer: A
- The answer is A
- A.
- Option A""",
}
FORMATS = {"pubmedqa": "Answer with ONLY: Yes, No, or Maybe", "bioasq": "Answer with ONLY: Yes or No", "choice": "YOUR RESPONSE MUST BE EXACTLY ONE LETTER: A, B, C, or D (nothing else)"}
FAILED = "Error: Could not get LLM response"
CHOICE_SETS = ("mmlu", "medqa", "medmcqa")


def _by_set(dataset: Column, values: dict) -> Column:
    return F.when(dataset == "pubmedqa", values["pubmedqa"]).when(dataset == "bioasq", values["bioasq"]).otherwise(values["choice"])


def prompts(results: DataFrame) -> DataFrame:
    """`system` and `user` messages from question, dataset and sorted_passage."""
    passages = F.concat_ws("", F.transform(F.coalesce("sorted_passage", F.array().cast("array<string>")), lambda p: F.concat(p, F.lit("\n\n"))))
    user = F.concat(F.lit("Context:\n"), passages, F.lit("Question with Options:\n"), F.col("question"), F.lit("\n\n"), _by_set(F.col("dataset"), FORMATS), F.lit("\n"))
    return results.withColumn("system", _by_set(F.col("dataset"), PROMPTS)).withColumn("user", user)


def stub_reader(system: str, user: str) -> str:
    """Offline reader: the first option letter or word that the format line asks for."""
    if "Yes, No, or Maybe" in system or "Yes or No" in user:
        return "Yes"
    return "A"


def read(prompted: DataFrame, reader=stub_reader) -> DataFrame:
    """Adds `raw_answer` by a plug-in reader, called in the tasks; a failing call gives the failure text."""
    schema = T.StructType([*prompted.schema.fields, T.StructField("raw_answer", T.StringType())])

    def run(it):
        for pdf in it:
            out = []
            for s, u in zip(pdf["system"], pdf["user"]):
                try:
                    out.append(reader(s, u))
                except Exception:
                    out.append(FAILED)
            yield pdf.assign(raw_answer=out)

    return prompted.mapInPandas(run, schema)


def answer(results: DataFrame, reader=stub_reader) -> DataFrame:
    """Prompts, reads and parses; adds pred_answer."""
    return read(prompts(results), reader).withColumn("pred_answer", parse_answer(F.col("raw_answer"), F.col("dataset"))).drop("system", "user", "raw_answer")


def is_valid(pred: Column, dataset: Column) -> Column:
    low = F.lower(pred)
    return F.when(dataset == "pubmedqa", low.isin("yes", "no", "maybe")).when(dataset == "bioasq", low.isin("yes", "no")).otherwise(low.isin("a", "b", "c", "d"))


def contains_gold(question: Column, gold: Column, dataset: Column, joined: Column) -> Column:
    """Does the passages' lower-cased text hold the gold option's text (choice sets) or the gold itself (others)."""
    g = F.lower(norm(gold))
    lines = F.transform(F.split(norm(question), r"\r\n|\r|\n"), strip)
    option = F.get(F.filter(lines, lambda x: F.lower(x).startswith(F.concat(g, F.lit(".")))), F.lit(0))
    text = F.lower(strip(F.regexp_replace(option, r"(?s)^[^.]*\.", "")))
    return F.when(dataset.isin(*CHOICE_SETS), F.coalesce((text != "") & F.contains(joined, text), F.lit(False))).otherwise((g != "") & F.contains(joined, g))


def judged(results: DataFrame) -> DataFrame:
    """correct, invalid, contain_correct, no_entity flags (0/1) of each result."""
    ds = F.lower(F.when(F.coalesce("dataset", F.lit("")) == "", "unknown").otherwise(F.col("dataset")))
    pred, gold = norm(F.col("pred_answer")), norm(F.col("answer"))
    joined = F.lower(F.concat_ws(" ", F.transform("sorted_passage", norm)))
    has = F.coalesce(F.size("sorted_passage"), F.lit(0)) > 0
    ok = is_valid(pred, ds)
    return results.withColumn("dataset", ds).withColumns({
        "correct": (ok & (F.lower(pred) == F.lower(gold))).cast("int"),
        "invalid": (~ok).cast("int"),
        "contain_correct": F.coalesce(has & contains_gold(F.col("question"), gold, ds, joined), F.lit(False)).cast("int"),
        "no_entity": (~F.coalesce("has_entities", F.lit(True))).cast("int"),
    })


def summarize(results: DataFrame) -> DataFrame:
    """Counts and rates by data set, and a last line `ALL`, in one rollup."""
    j = judged(results)
    sums = [F.sum(c).cast("long").alias(c) for c in ("correct", "invalid", "contain_correct", "no_entity")]
    s = j.rollup("dataset").agg(F.grouping("dataset").alias("g"), F.count(F.lit(1)).alias("total"), *sums)
    pct = lambda a: F.round(100 * ratio(a, F.col("total")), 6)
    return s.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("dataset")).alias("dataset"), "total", "correct", "invalid", "contain_correct", "no_entity", pct(F.col("correct")).alias("accuracy"), pct(F.col("contain_correct")).alias("contain_accuracy"), pct(F.col("total") - F.col("invalid")).alias("valid_rate"))


def invalid_samples(results: DataFrame, n: int = 20) -> DataFrame:
    """The first n invalid answers by input position."""
    j = judged(results).where("invalid = 1")
    return j.orderBy("idx").limit(n).select("idx", "dataset", F.substring(norm(F.col("pred_answer")), 1, 120).alias("pred_answer"), F.substring(norm(F.col("question")), 1, 200).alias("question"))


def distribution(answers: DataFrame, col: str) -> DataFrame:
    """Value counts with their share of all."""
    c = answers.groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = c.agg(F.sum("n").alias("total"))
    return c.crossJoin(F.broadcast(total)).select("value", "n", F.round(100 * F.col("n") / F.col("total"), 6).alias("pct"))  # total has one row


def first_examples(rows: DataFrame, by: str, order: str, n: int = 3) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order)
    return rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def running_mean(rows: DataFrame, col: str, order: str, by: str | None = None) -> DataFrame:
    """Adds `running`: the mean of the group's rows up to this one."""
    one = rows.withColumns({"_value": F.col(col).cast("double"), "_one": F.lit(1)})
    sums = running_sums(one, ["_value", "_one"], [order], [by] if by else None)
    return sums.withColumn("running", F.round(F.col("_value_upto") / F.col("_one_upto"), 6)).drop("_value", "_one", "_value_upto", "_one_upto")


def gold_found(items: DataFrame, texts: DataFrame, prefix: int = 100, block_bytes: int = 16 << 20) -> DataFrame:
    """item_id, found: does any text contain the item's first characters, or the item a text's.

    The items are a query set held against all texts, in blocks of at most about `block_bytes`, each broadcast."""
    head = lambda c: F.substring(c, 1, prefix)
    i = cut(items.where("text is not null").select("item_id", F.col("text").alias("item_text")))
    blocks = max(1, -(-(i.agg(F.sum(F.octet_length("item_text") + 16)).first()[0] or 0) // block_bytes))
    t = texts.where(F.coalesce("text", F.lit("")) != "").select("text", head("text").alias("head"))
    hit = None
    for b in range(blocks):
        part = F.broadcast(i.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b).withColumn("item_head", head("item_text")))
        got = t.join(part, F.contains("text", "item_head") | F.contains("item_text", "head")).select("item_id").distinct()
        hit = got if hit is None else hit.unionByName(got)
    hit = hit.distinct().withColumn("found", F.lit(True))
    return items.select("item_id").join(hit, "item_id", "left").select("item_id", F.coalesce("found", F.lit(False)).alias("found"))


def timing_means(lines: DataFrame, pattern: str, last: int) -> DataFrame:
    """log, mean of the last n numbers that the pattern finds in each log (log, text)."""
    found = F.transform(F.regexp_extract_all("text", F.lit(pattern), 1), lambda x: x.cast("double"))
    tail = F.slice(found, F.greatest(F.lit(1), F.size(found) - last + 1), last)
    mean = F.when(F.size(found) > 0, F.aggregate(tail, F.lit(0.0), lambda s, x: s + x) / F.size(tail))
    return lines.select("log", F.round(mean, 6).alias("mean"))


def speedups(means: DataFrame, order: str) -> DataFrame:
    """Each row's speed against the first row's."""
    first = means.agg(F.min_by("mean", order).alias("_first"))  # one row
    return means.crossJoin(F.broadcast(first)).withColumn("speedup", F.round(ratio(F.col("_first"), F.col("mean")), 6)).drop("_first")
