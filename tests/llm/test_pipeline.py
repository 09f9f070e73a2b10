"""The pipeline, stage by stage, against brute force on small tables."""

import random
import re

import corpus_pipeline
from skein.llm import mixing, quality_rules

from .test_pair_operators import alignment, spans_by_hand

DIR = "/root/testdata/sf0.001"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


def test_stages_chain(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DIR)
        assert out.columns == columns, name
        rows = out.collect()
        assert 0 < len(rows) <= before
        docs, before = spark.createDataFrame(rows, docs.schema), len(rows)
    texts = {r.doc_id: r.text for r in rows}
    taken = corpus_pipeline.STAGES[-1][1](spark, docs, DIR).collect()
    assert {r.doc_id: r["size"] for r in taken} == {k: len(words(t)) for k, t in texts.items()}
    # No two documents that are left are near duplicates, and none holds a test item.
    sets = {k: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for k, t in texts.items() for w in [words(t.lower())]}
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            k = len(sets[a] & sets[b])
            assert not k or 100 * k < 80 * len(sets[a] | sets[b])
    items = [" ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", r.text.lower())) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    for t in texts.values():
        own = " ".join(re.findall("[a-z0-9\x80-\U0010ffff]+", t.lower()))
        assert not any(x and x in own for x in items)


def test_quality_stage_keeps_what_the_operator_keeps(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).where("kept").collect()}
    assert kept == {r.doc_id for r in corpus_pipeline.quality(spark, docs, DIR).collect()}


def test_stages_on_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = " ".join(f"word{i}" for i in range(90)) + "."
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, text, None, None, 9), (3, text, None, None, 9), (4, text + " more", "en", "b", 9), (None, text.replace("word", "other"), None, "c", 9)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, DIR)
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        got = [r.doc_id for r in docs.collect()]
        assert sorted(got, key=str) == ([3, None] if data else [])


def copies(seed=9):
    """Texts with exact, near and partial copies, with ids, without and shared; longer than 50 words."""
    rnd = random.Random(seed)
    word = lambda: f"v{rnd.randrange(3000)}"
    sentence = lambda: " ".join(word() for _ in range(rnd.randrange(6, 15))) + "."
    rows = []
    for g in range(12):
        base = [sentence() for _ in range(12)]
        for c in range(1 + g % 3):
            t = " ".join(base).split()
            for _ in range(c):
                t[rnd.randrange(len(t))] = word()
            rows.append((None if g in (4, 8) else 10 * g + c, " ".join(t)))
    shared = " ".join(sentence() for _ in range(7))
    rows += [(200 + i, " ".join([*(sentence() for _ in range(8)), shared])) for i in range(3)]
    rows += [(rows[0][0], rows[0][1]), (7, " ".join(sentence() for _ in range(9))), (7, " ".join(sentence() for _ in range(9))), (300, None), (301, ""), (302, " ".join(word() for _ in range(120_000)))]
    return rows


CLASH = "n_words string, score string, kept string, _key string, _stays string, n_removed string, _text string, doc long, _carried0 string"


def frame(spark, rows, extra=True):
    schema = "doc_id long, text string, lang string, source string, n_chars long" + (f", {CLASH}" if extra else "")
    more = (*("clash" for _ in range(7)), 5, "own") if extra else ()
    return spark.createDataFrame([(d, t, None, None, len(t or ""), *more) for d, t in rows], schema).repartition(3)


def test_stages_carry_clashing_columns(spark):
    docs = frame(spark, copies())
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, DIR).collect(), docs.schema)
        assert docs.columns == columns, name
        assert {(r.n_words, r.kept, r._key, r.n_removed, r._text, r.doc, r._carried0) for r in docs.collect()} == {("clash",) * 5 + (5, "own")}
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DIR).count() == docs.count() > 10


def test_near_duplicates_match_brute_force(spark):
    rows = copies()
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for _, t in distinct for w in [words((t or "").lower())]]
    root = list(range(len(distinct)))
    for i in range(len(distinct)):
        for j in range(i):
            k = len(sets[i] & sets[j])
            if k and 100 * k >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [b if x == a else x for x in root]
    groups = {}
    for r, x in zip(distinct, root):
        groups.setdefault(x, []).append(r)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, frame(spark, rows), DIR).collect()]
    assert len(got) == len(groups) == len(set(got))
    for g in groups.values():
        stays = [r for r in got if r in g]
        assert len(stays) == 1 and (stays[0][0] is None) == all(d is None for d, _ in g)
        assert stays[0][0] == min((d for d, _ in g if d is not None), default=None)


def test_repeated_spans_match_brute_force(spark):
    rows = [r for r in copies() if r[0] != 7 and r[0] is not None]
    rows = list(dict(rows).items())
    docs, gone = spans_by_hand(rows, 30)
    got = {r.doc_id: r for r in corpus_pipeline.repeated_spans(spark, frame(spark, rows), DIR).collect()}
    left = {d: [w for k, s in enumerate(docs[d]) if k not in gone[d] for w in s] for d in docs}
    assert set(got) == {d for d in docs if left[d] or not gone[d]}
    for d, r in got.items():
        assert words(r.text) == left[d] and r.n_chars == len(r.text or "")
    assert sum(map(bool, gone.values())) >= 3


def test_test_items_match_brute_force(spark):
    clean = lambda t: re.findall("[a-z0-9\x80-\U0010ffff]+", (t or "").lower())
    items = [clean(r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    rnd = random.Random(2)
    rows = [r for r in copies() if r[0] != 302][:20]
    for k in range(8):
        own = list(items[k])
        for _ in range(k):
            own[rnd.randrange(len(own))] = "edited"
        rows.append((None if k % 4 == 1 else 500 + k, f"{rows[k][1]} {' '.join(own)} {rows[k + 1][1]}"))
    want = {(d, t) for d, t in rows if not any(alignment(x, clean(t)) >= max(len(x), 2 * min(len(x), 4)) for x in items if x)}
    got = [(r.doc_id, r.text) for r in corpus_pipeline.test_items(spark, frame(spark, rows), DIR).collect()]
    assert set(got) == want and len(got) == sum(r in want for r in rows)
    assert want == set(rows[:20])


def test_mixture_takes_what_the_operator_takes(spark):
    docs = frame(spark, copies())
    assert sorted(map(tuple, corpus_pipeline.mixture(spark, docs, DIR).collect()), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
