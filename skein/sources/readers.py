"""Readers of corpora and question sets, all with explicit schemas."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions.text import first_filled, norm, strip

CHUNK = "contents string, text string, content string, passage string"
FIELDS = ("contents", "text", "content", "passage")
QUESTION = ["question", "answer", "dataset"]


def _lines(spark: SparkSession, paths, glob: str | None = None) -> DataFrame:
    """path, line, value of every line of whole files, so that positions are exact."""
    reader = spark.read.option("wholetext", True).option("ignoreCorruptFiles", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    t = reader.text(paths).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")).where(strip(F.col("value")) != "")


def ordered_limit(df: DataFrame, n: int | None, *order: str) -> DataFrame:
    """The first n rows in order; None or a negative n means all."""
    return df if n is None or n < 0 else df.orderBy(*order).limit(n)


def jsonl_corpus(spark: SparkSession, path: str, limit: int | None = None, fields: tuple = FIELDS, glob: str = "*.jsonl") -> DataFrame:
    """path, line, text of a folder of JSONL chunks, in (file, line) order.

    The first non-empty field counts; malformed lines and texts of white space are dropped."""
    rows = _lines(spark, path, glob).withColumn("j", F.from_json("value", CHUNK, {"mode": "PERMISSIVE"}))
    rows = rows.withColumn("text", norm(first_filled(*(F.col(f"j.{f}") for f in fields)))).where("text <> ''")
    return ordered_limit(rows.select("path", "line", "text"), limit, "path", "line")


def prioritized_corpus(spark: SparkSession, priority: str, path: str, limit: int, glob: str = "pubmed23n*.jsonl") -> DataFrame:
    """All texts of the priority file, then others up to `limit` in all; prio, path, line, text."""
    order = ("text", "contents", "content")
    first = jsonl_corpus(spark, priority, None, order, "*").withColumn("prio", F.lit(0))
    rest = jsonl_corpus(spark, path, None, order, glob).withColumn("prio", F.lit(1))
    return ordered_limit(first.unionByName(rest), max(limit, first.count()) if limit >= 0 else limit, "prio", "path", "line")


def standard_chunks(spark: SparkSession, path: str) -> DataFrame:
    """idx, text of a JSON array of strings, as `idx:text`."""
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "chunk")).select("idx", F.concat(F.col("idx").cast("string"), F.lit(":"), "chunk").alias("text"))


def standard_questions(spark: SparkSession, path: str, schema: str = "question string, answer string") -> DataFrame:
    raw = spark.read.option("wholetext", True).text(path)
    return raw.select(F.posexplode(F.from_json("value", f"array<struct<{schema.replace(' string', ':string')}>>")).alias("idx", "q")).select("idx", "q.*")


def with_options(question, options):
    """Question text with its options in key order, one `K. text` a line."""
    lines = F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(strip(e["key"]), F.lit(". "), norm(e["value"])))
    return F.when(F.size(options) > 0, F.concat(question, F.lit("\n"), F.array_join(lines, "\n"))).otherwise(question)


def medqa(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    rows = _lines(spark, path).withColumn("j", F.from_json("value", "question string, answer_idx string, options map<string,string>"))
    q, a = norm(F.col("j.question")), norm(F.col("j.answer_idx"))
    rows = rows.select("path", "line", q.alias("q"), a.alias("answer"), F.col("j.options").alias("options")).where("q <> '' and answer <> ''")
    return ordered_limit(rows, limit, "path", "line").select("line", with_options(F.col("q"), F.col("options")).alias("question"), "answer", F.lit("medqa").alias("dataset"))


def medmcqa(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """`cop` 1 to 4 are A to D; anything else is A."""
    rows = _lines(spark, path).withColumn("j", F.from_json("value", "question string, opa string, opb string, opc string, opd string, cop int"))
    letter = F.when(F.col("j.cop").between(1, 4), F.get(F.array(*map(F.lit, "ABCD")), F.col("j.cop") - 1)).otherwise("A")
    lines = F.concat_ws("\n", norm(F.col("j.question")), *(F.concat(F.lit(f"{k}. "), norm(F.col(f"j.op{k.lower()}"))) for k in "ABCD"))
    rows = rows.where(norm(F.col("j.question")) != "").select("path", "line", lines.alias("question"), letter.alias("answer"), F.lit("medmcqa").alias("dataset"))
    return ordered_limit(rows, limit, "path", "line").drop("path")


def pubmedqa(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    item = "struct<QUESTION:string,CONTEXTS:array<string>,LABELS:array<string>,LONG_ANSWER:string,final_decision:string>"
    raw = spark.read.option("wholetext", True).text(path)
    rows = raw.select(F.posexplode(F.from_json("value", f"map<string,{item}>")).alias("pos", "pmid", "r"))
    rows = rows.select("pos", "pmid", norm(F.col("r.QUESTION")).alias("question"), F.lower(norm(F.col("r.final_decision"))).alias("answer"), F.lit("pubmedqa").alias("dataset"))
    return ordered_limit(rows.where("question <> '' and answer in ('yes', 'no', 'maybe')"), limit, "pos")


def bioasq(spark: SparkSession, root: str, limit: int | None = None, pattern: str = "Task*BGoldenEnriched/*_golden.json") -> DataFrame:
    """Yes/no questions whose exact answer is one string; a list answer reads as its raw text and drops out."""
    item = "struct<id:string,type:string,body:string,exact_answer:string>"
    raw = spark.read.option("wholetext", True).text(f"{root}/{pattern}").select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.from_json("value", f"questions array<{item}>")["questions"]).alias("pos", "q"))
    rows = raw.select("path", "pos", F.col("q.id").alias("id"), norm(F.col("q.body")).alias("question"), F.lower(norm(F.col("q.exact_answer"))).alias("answer"), F.lit("bioasq").alias("dataset"), F.col("q.type").alias("type"))
    return ordered_limit(rows.where("type = 'yesno' and answer in ('yes', 'no') and question <> ''").drop("type"), limit, "path", "pos")


def mmlu(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Headerless CSV files of question, four options and the gold letter."""
    cols = "question string, A string, B string, C string, D string, gold string"
    t = spark.read.schema(cols).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").csv(path, pathGlobFilter="*.csv")
    t = t.withColumn("subject_file", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.csv)?$", 1)).withColumn("pos", F.monotonically_increasing_id())
    gold = F.upper(norm(F.col("gold")))
    lines = F.concat_ws("\n", norm(F.col("question")), *(F.concat(F.lit(f"{k}. "), norm(F.col(k))) for k in "ABCD"))
    rows = t.where(gold.isin("A", "B", "C", "D") & (norm(F.col("question")) != "")).select("subject_file", "pos", lines.alias("question"), gold.alias("answer"), F.lit("mmlu").alias("dataset"))
    return ordered_limit(rows, limit, "subject_file", "pos")


LOADERS = {"medqa": medqa, "medmcqa": medmcqa, "pubmedqa": pubmedqa, "bioasq": bioasq, "mmlu": mmlu}


def questions(spark: SparkSession, sets: list[str], paths: dict[str, str], limit: int | None = None) -> DataFrame:
    """All asked sets in order, each with its own limit; an unknown name raises ValueError."""
    out = None
    for pos, name in enumerate(sets):
        if name not in LOADERS:
            raise ValueError(f"unknown data set: {name}")
        q = LOADERS[name](spark, paths[name], limit).withColumn("set_pos", F.lit(pos))
        out = q if out is None else out.unionByName(q, allowMissingColumns=True)
    return out


def context_chunks(spark: SparkSession, path: str) -> DataFrame:
    """One chunk for each pmid: its contexts joined by spaces."""
    item = "struct<QUESTION:string,CONTEXTS:array<string>,LABELS:array<string>,LONG_ANSWER:string,final_decision:string>"
    raw = spark.read.option("wholetext", True).text(path)
    r = raw.select(F.explode(F.from_json("value", f"map<string,{item}>")).alias("pmid", "r"))
    return r.select("pmid", F.array_join("r.CONTEXTS", " ").alias("text"), F.col("r.QUESTION").alias("question"), F.col("r.final_decision").alias("answer"), F.col("r.LONG_ANSWER").alias("long_answer"), F.col("r.CONTEXTS").alias("contexts"), F.col("r.LABELS").alias("labels"), F.lit("pubmedqa").alias("source"))


def abstract_chunks(abstracts: DataFrame, originals: DataFrame) -> DataFrame:
    """Non-empty abstracts as chunks, with question and answer looked up by pmid."""
    return abstracts.where(norm(F.col("abstract")) != "").join(originals.select("pmid", "question", "answer"), "pmid", "left").select("pmid", norm(F.concat_ws("\n\n", "title", "abstract")).alias("text"), "question", "answer")


def section_text(sections):
    """Labelled abstract sections (a map) as `LABEL: text` lines."""
    return F.array_join(F.transform(F.map_entries(sections), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def resume(ids: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What is still to be fetched."""
    return ids.join(done.select(key), key, "left_anti")


def concat_corpora(*corpora: DataFrame) -> DataFrame:
    out = corpora[0]
    for c in corpora[1:]:
        out = out.unionByName(c, allowMissingColumns=True)
    return out


def id_overlap(ids: DataFrame, corpus: DataFrame, key: str) -> DataFrame:
    """pmid, found: by any of the four key formats."""
    forms = ids.select("pmid", F.explode(F.array(F.col("pmid"), F.concat(F.lit("PMID:"), "pmid"), F.concat(F.lit("pubmed_"), "pmid"), F.concat(F.lit("PubMed_"), "pmid"))).alias("form"))
    hit = forms.join(corpus.select(F.col(key).alias("form")).distinct(), "form").select("pmid").distinct()
    return ids.select("pmid").distinct().join(hit.withColumn("found", F.lit(True)), "pmid", "left").select("pmid", F.coalesce("found", F.lit(False)).alias("found"))


def label_counts(contexts: DataFrame, n: int = 10) -> DataFrame:
    """The n most frequent labels, with counts; ties by label."""
    return contexts.select(F.explode("labels").alias("label")).groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "label").limit(n)


def coverage(abstracts: DataFrame) -> DataFrame:
    """Count, covered count and length statistics of abstracts."""
    n = F.length(norm(F.col("abstract")))
    return abstracts.agg(F.count(F.lit(1)).alias("total"), F.sum((n > 0).cast("long")).alias("with_abstract"), F.avg(F.when(n > 0, n)).alias("avg_length"), F.min(F.when(n > 0, n)).alias("min_length"), F.max(n).alias("max_length"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """Files of an index folder with their sizes."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    except AnalysisException:
        return spark.createDataFrame([], "path string, length long")


def last_rows(df: DataFrame, order: str, n: int) -> DataFrame:
    """The n rows that stand last; each task hands on n at most."""
    return df.orderBy(F.col(order).desc()).limit(n)


def legacy_medqa(spark: SparkSession, path: str) -> DataFrame:
    """pos, question (options in the file's order), answer text, answer_idx and phrases of a JSON array."""
    item = "struct<question:string,options:map<string,string>,answer_idx:string,metamap_phrases:array<string>>"
    raw = spark.read.option("wholetext", True).text(path)
    r = raw.select(F.posexplode(F.from_json("value", f"array<{item}>")).alias("pos", "r"))
    lines = F.transform(F.map_entries("r.options"), lambda e: F.concat(e["key"], F.lit(". "), e["value"], F.lit("\n")))
    question = F.concat(F.col("r.question"), F.lit("\n"), F.array_join(lines, ""))
    return r.select("pos", question.alias("question"), F.try_element_at("r.options", F.col("r.answer_idx")).alias("answer"), F.col("r.answer_idx").alias("answer_idx"), F.coalesce("r.metamap_phrases", F.array().cast("array<string>")).alias("metamap_phrases"))


def id_in_text(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """pmid, found: does the number stand in any text; digits of the texts are joined with the ids, windows of longer numbers included."""
    sizes = [r[0] for r in ids.select(F.length("pmid")).distinct().collect()]  # lengths of numbers, few
    runs = texts.select(F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+"), 0))).alias("n")).distinct()
    parts = F.flatten(F.transform(F.array(*map(F.lit, sizes or [1])), lambda k: F.when(F.length("n") >= k, F.transform(F.sequence(F.lit(1), F.length("n") - k + 1), lambda i: F.substring(F.col("n"), i, k))).otherwise(F.array().cast("array<string>"))))
    hit = runs.select(F.explode(parts).alias("pmid")).distinct()
    return ids.select("pmid").distinct().join(hit.withColumn("found", F.lit(True)), "pmid", "left").select("pmid", F.coalesce("found", F.lit(False)).alias("found"))
