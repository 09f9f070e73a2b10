"""Text functions as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SENTENCE = r"[^.!?\n]+[.!?]*"
TOKEN = "[a-z]{5,}"


def strip(c: Column) -> Column:
    """Trim all Unicode white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def norm(c: Column) -> Column:
    """Null as empty, trimmed."""
    return strip(F.coalesce(c.cast("string"), F.lit("")))


def first_filled(*cols: Column) -> Column:
    """First value that is neither null nor empty; white space counts as a value."""
    return F.coalesce(*(F.when(c != "", c) for c in cols))


def occurrences(text: Column, part: Column) -> Column:
    """Non-overlapping, case-sensitive count of a substring; 0 for an empty one."""
    gone = F.length(text) - F.length(F.replace(text, part, F.lit("")))
    return F.when(F.length(part) > 0, gone / F.length(part)).otherwise(0).cast("long")


def sentences(text: Column, least: int = 10) -> Column:
    """Trimmed sentences with at least `least` characters."""
    found = F.transform(F.regexp_extract_all(text, F.lit(SENTENCE), 0), strip)
    return F.filter(found, lambda s: F.length(s) >= least)


def tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), 0))


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def truncate(c: Column, n: int, mark: str = "...") -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit(mark))).otherwise(c)


def ratio(a: Column, b: Column) -> Column:
    """0 where the denominator is 0."""
    return F.when(b != 0, a / b).otherwise(0.0)


PUNCTUATION = r"[!-/:-@\[-`{-~]"


def normalize_answer(c: Column) -> Column:
    """Lower case, no ASCII punctuation, no articles, single spaces."""
    c = F.regexp_replace(F.lower(c), PUNCTUATION, "")
    c = F.regexp_replace(c, r"\b(a|an|the)\b", " ")
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def answer_letter(c: Column) -> Column:
    """The letter that starts the text after the last `Answer:`, else the last lone A-D, else the text."""
    after = strip(F.element_at(F.split(c, "Answer:"), -1))
    lead = F.regexp_extract(after, r"^([A-D])\b", 1)
    lone = F.regexp_extract_all(c, F.lit(r"\b([A-D])\b"), 1)
    return F.when(c.contains("Answer:") & (lead != ""), lead).when(F.size(lone) > 0, F.element_at(lone, -1)).otherwise(strip(c))


def parse_choice(c: Column) -> Column:
    """Multiple choice: the lone letter, else the first lone A-D, else the first A-D anywhere; upper-cased first, so an article `a` reads as A."""
    up = F.upper(strip(c))
    lone = F.regexp_extract(up, r"\b([ABCD])\b", 1)
    some = F.regexp_extract(up, r"[ABCD]", 0)
    return F.when(up.isin("A", "B", "C", "D"), up).when(lone != "", lone).when(some != "", some).otherwise("INVALID")


def parse_words(c: Column, *words: str) -> Column:
    """First of the given words, any case, capitalised; else INVALID."""
    hit = F.regexp_extract(c, rf"(?i)\b({'|'.join(words)})\b", 1)
    return F.when(hit == "", "INVALID").otherwise(F.initcap(F.lower(hit)))


def parse_answer(text: Column, dataset: Column) -> Column:
    return F.when(dataset == "pubmedqa", parse_words(text, "yes", "no", "maybe")).when(dataset == "bioasq", parse_words(text, "yes", "no")).otherwise(parse_choice(text))


# Keyword alternations of the fallback extractor.
KEYWORDS = [
    "infection|syndrome|disease|disorder|cancer|tumor|carcinoma|adenocarcinoma|sarcoma",
    "fever|pain|cough|nausea|vomiting|diarrhea|headache|fatigue|weakness",
    "diabetes|hypertension|asthma|pneumonia|hepatitis|tuberculosis|meningitis",
    "arthritis|dermatitis|nephritis|bronchitis|colitis|gastritis",
    "cisplatin|carboplatin|azithromycin|metformin|insulin|aspirin|ibuprofen",
    "drug|medication|therapy|treatment|antibiotic|chemotherapy|analgesic",
    "virus|bacteria|bacterial|viral|fungal|parasitic|pathogen",
    "cardiac|pulmonary|renal|hepatic|neurological|respiratory|gastrointestinal",
]

# Typed patterns.
TYPED = {
    "DRUG": r"\b[A-Z][a-z]+(?:cillin|mycin|oxacin|zole|prazole|sartan|olol)\b",
    "DISEASE": r"\b(?:carcinoma|adenocarcinoma|lymphoma|leukemia|sarcoma)\b",
    "SYMPTOM": r"\b(?:pain|fever|cough|nausea|vomiting|dyspnea|tachycardia)\b",
    "LAB": r"\b(?:hemoglobin|leukocyte|platelet|glucose|creatinine)\s+(?:count|level)\b",
}

# Terms and abbreviations of the dictionary extractor.
TERMS = ["cells", "nucleus", "lymphocyte", "monocyte", "blood", "tissue", "organ", "gland", "membrane", "cardiac cycle", "systole", "diastole", "stroke volume", "translation", "transcription", "glycolysis", "metabolism", "ATP", "DNA", "RNA", "protein", "enzyme", "glucose", "bone", "finger", "hand", "heart", "vessel", "pain", "disease", "syndrome", "disorder", "gene", "chromosome", "monosomy", "trisomy", "exon", "intron"]
ABBREVIATIONS = ["ATP", "DNA", "RNA", "NHS", "ECG", "MRI", "CT"]
NOT_NAMES = ["The", "What", "Which", "When", "Where", "Who", "How"]

# Query expansions, in order; the last text of a repeated term stands at its first place.
EXPANSIONS = {
    "mi": "myocardial infarction heart attack",
    "copd": "chronic obstructive pulmonary disease emphysema",
    "htn": "hypertension high blood pressure",
    "dm": "diabetes mellitus",
    "chf": "congestive heart failure",
    "cad": "coronary artery disease",
    "uti": "urinary tract infection",
    "tb": "tuberculosis",
    "hiv": "human immunodeficiency virus aids",
    "pneumonia": "lung infection respiratory inflammation",
    "carcinoma": "cancer tumor malignancy neoplasm",
    "adenocarcinoma": "glandular cancer tumor",
    "lymphoma": "lymph node cancer",
    "leukemia": "blood cancer",
    "stroke": "cerebrovascular accident cva brain infarction",
    "sepsis": "blood infection septicemia",
    "asthma": "airway obstruction bronchospasm",
    "dyspnea": "shortness of breath breathing difficulty",
    "tachycardia": "rapid heart rate fast heartbeat",
    "bradycardia": "slow heart rate",
    "hypotension": "low blood pressure",
    "hypertension": "high blood pressure elevated bp",
    "fever": "pyrexia elevated temperature",
    "pain": "discomfort ache",
    "nausea": "sick feeling vomiting",
    "antibiotic": "antimicrobial antibacterial medication",
    "chemotherapy": "cancer treatment cytotoxic therapy",
    "radiation": "radiotherapy irradiation treatment",
    "surgery": "operation surgical procedure",
}

# Clinical reranking.
CLINICAL_PATTERNS = [
    r"\b\d+[-/]year[-]old\b",
    r"\b(?:mg|mcg|ml|mmhg|mm\s*hg|g/dl)\b",
    r"\b(?:presents?|complain|history|symptom|sign)\b",
    r"\b(?:treatment|therapy|medication|drug|prescription)\b",
    r"\b(?:diagnosed?|diagnosis|prognosis|differential)\b",
    r"\b(?:patient|clinical|medical|case)\b",
    r"\b(?:elevated|decreased|increased|reduced)\b",
    r"\b(?:acute|chronic|recurrent|persistent)\b",
]
CLINICAL_TERMS = ["patient", "treatment", "therapy", "clinical", "diagnosis", "symptoms", "disease", "disorder", "condition", "management"]
RESEARCH_TERMS = ["experiment", "methodology", "statistical", "protocol", "study design"]
CASE_PHRASES = ["case report", "clinical presentation", "patient presented", "physical examination"]


def keyword_entities(c: Column) -> Column:
    """Distinct keywords of a text, sorted."""
    found = [F.regexp_extract_all(F.lower(c), F.lit(rf"\b(?:{k})\b"), 0) for k in KEYWORDS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def typed_entities(c: Column) -> Column:
    """Array of (text, type) by the typed patterns."""
    def typed(kind: str, pattern: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), 0), lambda t: F.struct(t.alias("text"), F.lit(kind).alias("type")))

    found = [typed(k, p) for k, p in TYPED.items()]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def dictionary_entities(c: Column) -> Column:
    """Dictionary terms, abbreviations, capitalised words and numbers with units; sorted and distinct."""
    low = F.lower(c)
    terms = F.filter(F.array(*map(F.lit, TERMS)), lambda t: F.contains(low, F.lower(t)))
    short = F.filter(F.array(*map(F.lit, ABBREVIATIONS)), lambda t: F.contains(c, t))
    names = F.transform(F.split(strip(c), r"\s+"), lambda w: F.regexp_replace(w, r"[^\w\s-]", ""))
    names = F.filter(names, lambda w: w.rlike("^[A-Z]") & (F.length(w) > 2) & ~w.isin(*NOT_NAMES))
    units = F.regexp_extract_all(low, F.lit(r"\d+[\s-]?(?:mg|ml|kg|mm|cm|m|g|l)"), 0)
    return F.array_sort(F.array_distinct(F.concat(terms, short, names, units)))


def expand_query(c: Column) -> Column:
    """The question with the expansions of its whole-word terms appended in table order.

    The terms are single words, so none overlaps another, and one reading finds them all."""
    found = F.regexp_extract_all(F.lower(c), F.lit(rf"\b({'|'.join(EXPANSIONS)})\b"), 1)
    table = F.create_map(*(F.lit(x) for pair in EXPANSIONS.items() for x in pair))
    more = F.transform(F.array_intersect(F.array(*map(F.lit, EXPANSIONS)), found), lambda t: F.element_at(table, t))  # in the order of the table
    return F.concat_ws(" ", c, more)


def clinical_keywords(question: Column) -> Column:
    low = F.lower(question)
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(low, F.lit(p), 0) for p in CLINICAL_PATTERNS))))


def _count(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(w)).cast("int") for w in words))


def clinical_factor(keywords: Column, passage: Column) -> Column:
    """Factor of the clinical rerank for a passage and the question's keywords."""
    low = F.lower(passage)
    overlap = F.size(F.filter(keywords, lambda k: F.contains(low, k)))
    factor = 1 + F.least(overlap * 0.12, F.lit(0.6)) + F.least(_count(low, CLINICAL_TERMS) * 0.05, F.lit(0.35))
    factor = factor - F.when(low.rlike(r"19[67]\d"), 0.3).otherwise(0.0)
    factor = factor - F.when(_count(low, RESEARCH_TERMS) >= 2, 0.2).otherwise(0.0)
    return factor + F.when(_count(low, CASE_PHRASES) > 0, 0.15).otherwise(0.0)


def keyword_relevance(question: Column, passage: Column) -> Column:
    """Alphabetic question words of over five letters that the passage's first 200 characters have."""
    words = F.filter(F.split(F.lower(question), r"\s+"), lambda w: w.rlike("^[a-z]+$") & (F.length(w) > 5))
    head = F.lower(F.substring(passage, 1, 200))
    return F.size(F.filter(words, lambda w: F.contains(head, w)))
